"""Indicators of collection and recycling, as specified in documents only; weights and factors are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.operators.features import us

#: Fixed identifier formats.
ID_PATTERNS = {"report": r"^WR-[0-9]{4}$", "return": r"^BS-[0-9]{4}$", "bin": r"^BIN-[0-9]{3}$", "route": r"^ROUTE-[0-9]{8}-[0-9]{2}$", "run": r"^RUN-[0-9]{8}-[0-9]{2}$", "kpi": r"^KPI-[0-9]{8}-[0-9]{2}$"}


def overflow_incidents(log: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Bins that reached the threshold, of all, per UTC day."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct(F.when(F.col("fill_pct") >= threshold, F.col("bin_id"))).alias("overflowed"), F.count_distinct("bin_id").alias("bins"))


def stop_levels(stops: DataFrame, log: DataFrame) -> DataFrame:
    """Stops (stop_id, bin_id, us) with the bin's last level before them: one window over both, no range join."""
    both = log.select("bin_id", us().alias("us"), F.lit(0).alias("kind"), "fill_pct", F.lit(None).cast("long").alias("stop_id")).unionByName(stops.select("bin_id", "us", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("fill_pct"), "stop_id"))
    w = Window.partitionBy("bin_id").orderBy("us", "kind", "stop_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("level", F.last("fill_pct", ignorenulls=True).over(w)).where("kind = 1").select("stop_id", "bin_id", "us", "level")


def unnecessary_trips(stops: DataFrame, log: DataFrame, collect_at: float = 60.0) -> DataFrame:
    """Stops by route whose bin stood below the collection threshold; stops without any reading aren't judged."""
    x = stop_levels(stops, log).join(stops.select("stop_id", "route"), "stop_id")
    return x.groupBy("route").agg(F.count(F.lit(1)).alias("stops"), F.count_if(F.col("level") < collect_at).alias("unnecessary"), F.count_if(F.col("level").isNull()).alias("unknown"))


def route_sums(legs: DataFrame, litres_per_km: float, kg_co2_per_litre: float) -> DataFrame:
    """Distance, fuel and CO2 of each route from its legs (route, leg_km)."""
    x = legs.groupBy("route").agg(F.sum("leg_km").alias("km"))
    return x.select("route", "km", (F.col("km") * litres_per_km).alias("litres"), (F.col("km") * litres_per_km * kg_co2_per_litre).alias("kg_co2"))


def contamination(items: DataFrame, *by: str) -> DataFrame:
    """Rejected items as a share of inspected ones."""
    x = items.groupBy(*by).agg(F.count_if(F.col("result") == "rejected").alias("rejected"), F.count(F.lit(1)).alias("inspected"))
    return x.withColumn("contamination", F.try_divide("rejected", "inspected"))


def compare(kpis: DataFrame) -> DataFrame:
    """Baseline against priority for each (run, metric): change, percent where the baseline isn't 0, completeness; setups must be equal."""
    side = lambda m: [F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for c in ("value", "setup")]
    x = kpis.groupBy("run", "metric").agg(*side("baseline"), *side("priority"))
    change = F.col("priority_value") - F.col("baseline_value")
    valid = F.coalesce(F.col("baseline_setup") == F.col("priority_setup"), F.lit(False))
    return x.select("run", "metric", "baseline_value", "priority_value", valid.alias("valid"), F.when(valid, change).alias("change"), F.when(valid, F.try_divide(change * 100, F.abs("baseline_value"))).alias("change_pct"), (F.col("baseline_value").isNotNull() & F.col("priority_value").isNotNull()).alias("complete"))


def id_ok(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, p in ID_PATTERNS.items():
        out = F.when(kind == k, F.coalesce(value.rlike(p), F.lit(False))).otherwise(out)
    return out


def colour(fill: Column, predicted_overflow: Column | None = None) -> Column:
    red = fill > 85 if predicted_overflow is None else (fill > 85) | predicted_overflow
    return F.when(red, "red").when(fill >= 60, "amber").when(fill.isNotNull(), "green")


def priority(bins: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rank by a weighted sum of inputs in 0..1, which stay visible; ties by bin."""
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    x = bins.withColumn("score", score)
    return x.withColumn("place", F.rank().over(Window.partitionBy(*(["area"] if "area" in bins.columns else [F.lit(1)])).orderBy(F.desc(F.round("score", 9)), "bin_id")))


def sensor_alerts(log: DataFrame, flat_rows: int = 6, jump: float = 50.0, full_hours: float = 24.0) -> DataFrame:
    """(bin_id, us, alert): flat lines, jumps, impossible levels, full bins not collected, low voltage where it is measured."""
    w = Window.partitionBy("bin_id").orderBy("us", "seq")
    x = log.withColumn("us", us()).withColumn("_b", F.lag("fill_pct").over(w)).withColumn("_new", F.coalesce((F.col("fill_pct") != F.col("_b")).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_full", F.col("fill_pct") >= 90)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("bin_id", "_run").orderBy("us", "seq"))).withColumn("_since", F.max(F.when(~F.col("_full"), F.col("us"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_from", F.min(F.when(F.col("_full"), F.col("us"))).over(Window.partitionBy("bin_id", "_since")))
    low = F.when(F.col("voltage") < 3.3, "low_voltage") if "voltage" in log.columns else F.lit(None).cast("string")
    alerts = F.array(F.when(F.col("_n") == flat_rows, "flat_line"), F.when(F.col("fill_pct") - F.col("_b") > jump, "jump"), F.when(F.col("fill_pct") > 100, "above_100"), F.when(F.col("fill_pct") < 0, "below_0"), F.when(F.col("_full") & (F.col("us") - F.col("_from") > full_hours * 3.6e9), "not_collected"), low)
    return x.select("bin_id", "us", "seq", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("alert"))


def fill_at_pickup(log: DataFrame, drop_pct: float = 35.0) -> DataFrame:
    """Mean level just before each collection, per bin."""
    w = Window.partitionBy("bin_id").orderBy(us(), "seq")
    x = log.withColumn("_b", F.lag("fill_pct").over(w)).where(F.col("fill_pct") - F.col("_b") < -drop_pct)
    return x.groupBy("bin_id").agg(F.count(F.lit(1)).alias("pickups"), F.avg("_b").alias("mean_fill"))


def recycler_score(sessions: DataFrame, items: DataFrame, from_us: int, to_us: int, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), full_visits: int = 12) -> DataFrame:
    """Frequency, accepted share and cleanness of a resident's returns within a window, in 0..100."""
    s = sessions.where(F.col("created_us").between(from_us, to_us))
    n = items.groupBy("session_id").agg(F.count_if(F.col("result") == "accepted").alias("a"), F.count(F.lit(1)).alias("n"))
    x = s.join(n, "session_id", "left").groupBy("resident").agg(F.count(F.lit(1)).alias("visits"), F.coalesce(F.sum("a"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("n"), F.lit(0)).alias("inspected"), F.count_if(F.col("a") == F.col("n")).alias("clean"))
    f, r, c = F.least(F.lit(1.0), F.col("visits") / full_visits), F.coalesce(F.try_divide("accepted", "inspected"), F.lit(0.0)), F.col("clean") / F.col("visits")
    return x.withColumn("score", (f * weights[0] + r * weights[1] + c * weights[2]) * 100)


def paired_runs(runs: DataFrame) -> DataFrame:
    """Mean difference of paired runs (seed, mode, value) with a normal 95 % interval."""
    x = runs.groupBy("seed").agg(F.max(F.when(F.col("mode") == "baseline", F.col("value"))).alias("b"), F.max(F.when(F.col("mode") == "priority", F.col("value"))).alias("p")).select((F.col("p") - F.col("b")).alias("d")).where("d IS NOT NULL")
    y = x.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    half = F.col("sd") / F.sqrt("n") * 1.959964
    return y.select("n", "mean_diff", (F.col("mean_diff") - half).alias("low"), (F.col("mean_diff") + half).alias("high"))


def duplicate_scans(items: DataFrame) -> DataFrame:
    """Items scanned more than once in a session."""
    return items.groupBy("session_id", "item_id").agg(F.count(F.lit(1)).alias("scans")).where("scans > 1")
