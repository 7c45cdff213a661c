"""Features of bins with very long histories: windows by bin and time chunk, with what earlier chunks hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.operators.features import HOUR, RESET, SECOND, add_rate_features, add_time_features, dedup_last, timed
from fillwatch.session import stored

DAY = 86_400 * SECOND
KEY = ("bin_id", "_chunk")


def chunk_rates(df: DataFrame, days: int) -> DataFrame:
    """Deduplicated readings with rates, keyed by bin and chunk (_chunk, whole UTC days).

    No rate looks back more than 24 hours, so each chunk gets copies of the readings of the day before it, which are
    dropped again. _n and _last_drop count the chunk's own drops so far.
    """
    chunk = F.floor(F.col("_us") / (days * DAY))
    near = (chunk + 1) * (days * DAY) - F.col("_us") <= DAY
    x = timed(df.transform(add_time_features)).withColumn("_own", chunk)
    x = x.withColumn("_chunk", F.explode(F.when(near, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    x = x.transform(dedup_last, KEY).transform(add_rate_features, deduped=True, by=KEY).where("_own = _chunk").drop("_own")
    w = Window.partitionBy(*KEY).orderBy("_us")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_drop", F.coalesce(F.col("fill_pct") - F.lag("fill_pct").over(w) < -RESET, F.lit(False)))
    return x.withColumns({"_n": F.sum(F.col("_drop").cast("long")).over(run), "_last_drop": F.last(F.when(F.col("_drop"), F.col("_us")), ignorenulls=True).over(run)}).drop("_drop")


def carried(rates: DataFrame) -> DataFrame:
    """(bin_id, _chunk, _cycles, _reset): the cycles before a chunk's first reading or beginning with it, and the last reset then, by a scan over one row a chunk."""
    each = rates.groupBy(*KEY).agg(
        F.min("_us").alias("first_us"), F.min_by("fill_pct", "_us").alias("first_fill"), F.max_by("fill_pct", "_us").alias("last_fill"), F.max("_n").alias("n"), F.max("_last_drop").alias("last_drop")
    )
    w = Window.partitionBy("bin_id").orderBy("_chunk")
    before, run = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    x = each.withColumn("edge", F.coalesce(F.col("first_fill") - F.lag("last_fill").over(w) < -RESET, F.lit(False)))
    at_edge = F.when(F.col("edge"), F.col("first_us"))
    x = x.withColumn("reset", F.coalesce("last_drop", at_edge))
    earlier = F.last("reset", ignorenulls=True).over(before)
    cycles = F.coalesce(F.sum(F.col("n") + F.col("edge").cast("long")).over(before), F.lit(0)) + F.col("edge").cast("long")
    return x.select(*KEY, cycles.alias("_cycles"), F.coalesce(at_edge, earlier, F.first("first_us").over(run)).alias("_reset"))


def slot_means(rates: DataFrame) -> DataFrame:
    """(bin_id, _hour, _day, _past): mean of the daily mean rates of a bin and hour over strictly earlier days, from one row a bin, hour and day."""
    day = rates.groupBy("bin_id", "_hour", "_day").agg(F.avg("fill_rate_1h").alias("m"))
    before = Window.partitionBy("bin_id", "_hour").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return day.select("bin_id", "_hour", "_day", F.avg("m").over(before).alias("_past"))


def build_feature_table_chunked(df: DataFrame, days: int = 7) -> DataFrame:
    """build_feature_table() for logs in which one bin may have a large share of all readings: no task holds more than a chunk.

    Rates are computed by chunk and written once. From them come two small tables, one row a chunk and one row a bin, hour
    and day; each is scanned in order within its bin, and both are joined with the rates in one go, as a day lies in one
    chunk. An adaptive plan splits what is skewed in that join.
    """
    rates = chunk_rates(df, days).withColumns({"_hour": F.hour("ts"), "_day": F.unix_date(F.to_date("ts"))})
    rates = stored(rates, "rates")
    chunk = F.floor(F.col("_day") / days)
    known = slot_means(rates).withColumn("_chunk", chunk).hint("merge").join(carried(rates), [*KEY]).drop("_chunk")
    x = rates.hint("merge").join(known, ["bin_id", "_hour", "_day"])
    cycle = [] if "cycle_id" in df.columns else [(F.col("_cycles") + F.col("_n")).alias("cycle_id")]
    time = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"]
    out = x.select(
        *df.columns, *time, "fill_rate_1h", "fill_rate_6h", *cycle, ((F.col("_us") - F.coalesce("_last_drop", "_reset")) / HOUR).alias("time_since_reset_hours"), F.coalesce("_past", "fill_rate_1h").alias("hist_avg_rate_same_slot")
    )
    return out.fillna(0.0, ["fill_rate_1h", "fill_rate_6h", "hist_avg_rate_same_slot", "time_since_reset_hours"])
