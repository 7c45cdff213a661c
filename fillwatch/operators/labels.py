"""Time-to-threshold labels, risk levels, chronological splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.operators.features import FEATURES, HOUR, us

THRESHOLD = 90.0


def risk_level(hours: Column) -> Column:
    """[0,4) Critical, [4,12) High, [12,24) Medium, all else Low: also null, NaN, negative and infinite."""
    level = F.lit("Low")
    for low, high, name in ((12, 24, "Medium"), (4, 12, "High"), (0, 4, "Critical")):
        level = F.when((hours >= low) & (hours < high), name).otherwise(level)
    return level


def label_cycles(features: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """crossing_ts: when the row's fill cycle first measured the threshold; time_to_overflow_hours: until then, at least 0.

    Cycles that never reach it are censored: both null.
    """
    w = Window.partitionBy("bin_id", "cycle_id")
    x = features.withColumn("crossing_ts", F.min(F.when(F.col("fill_pct") >= threshold, F.col("ts"))).over(w))
    hours = (us("crossing_ts") - us()) / HOUR
    return x.withColumn("time_to_overflow_hours", F.when(F.col("crossing_ts").isNotNull(), F.greatest(F.lit(0.0), hours)))


def build_labels(features: DataFrame, drop_censored: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    x = label_cycles(features, threshold)
    if drop_censored:
        x = x.where("time_to_overflow_hours IS NOT NULL")
    return x.withColumn("risk_level", risk_level(F.col("time_to_overflow_hours")))


def chronological_split(df: DataFrame, val_from: str, test_from: str) -> DataFrame:
    """One column `split`, in place of three scans: train before val_from, val before test_from, then test."""
    v, t = F.lit(val_from).cast("timestamp"), F.lit(test_from).cast("timestamp")
    return df.withColumn("split", F.when(F.col("ts") < v, "train").when(F.col("ts") < t, "val").otherwise("test"))


def leaks_label(val_from: str, test_from: str) -> Column:
    """Whether a train or val row's crossing lies after its split's end; test rows and censored ones never leak."""
    end = F.when(F.col("split") == "train", F.lit(val_from)).when(F.col("split") == "val", F.lit(test_from)).cast("timestamp")
    return F.coalesce(F.col("crossing_ts") > end, F.lit(False))


def purge_label_leakage(df: DataFrame, val_from: str, test_from: str) -> DataFrame:
    return df.where(~leaks_label(val_from, test_from))


def naive_forecast(df: DataFrame, fallback_hours: Column | float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """naive_hours: what remains to the threshold at the present 1 h rate, within 0..200.

    Without a rate the fallback counts: by default the largest remainder of the whole input, a scalar subquery.
    """
    x = df.withColumn("_left", F.when(F.col("fill_pct").isNotNull(), F.greatest(F.lit(threshold) - F.col("fill_pct"), F.lit(0.0))))
    if fallback_hours is None:
        fallback_hours = x.agg(F.max("_left")).scalar()
    fallback = fallback_hours if isinstance(fallback_hours, Column) else F.lit(fallback_hours)
    hours = F.coalesce(F.try_divide(F.col("_left"), F.abs("fill_rate_1h")), fallback.cast("double"))
    return x.withColumn("naive_hours", F.when(hours.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(200.0), hours)))).drop("_left")


def evaluate(df: DataFrame, group: str = "model", truth: str = "time_to_overflow_hours", predicted: str = "predicted_hours") -> DataFrame:
    """Error and risk metrics of each model in one pass, rounded to 3."""
    err = F.col(predicted) - F.col(truth)
    rt, rp = risk_level(F.col(truth)), risk_level(F.col(predicted))
    out = df.groupBy(group).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg((rt == rp).cast("double")).alias("acc"),
        F.count_if((rt == "Critical") & (rp == "Critical")).alias("tp"), F.count_if(rt == "Critical").alias("p"), F.count(F.lit(1)).alias("n_rows"),
    )
    return out.select(group, F.round("mae", 3).alias("mae_hours"), F.round("rmse", 3).alias("rmse_hours"), F.round("acc", 3).alias("risk_accuracy"), F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0)), 3).alias("critical_recall"), "n_rows")


def select_model(metrics: DataFrame, order: list[str]) -> DataFrame:
    """The model of least rounded validation error, ties to the first listed."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return metrics.where(place > 0).orderBy("mae_hours", place).limit(1)


def quality_report(df: DataFrame) -> DataFrame:
    """(check_name, n) of a labelled table, all counted in one aggregate; a column that is absent counts among missing_columns alone."""
    needed = ["bin_id", "ts", *FEATURES, "time_to_overflow_hours", "risk_level"]
    have = [c for c in needed if c in df.columns]
    bad = {
        "fill_out_of_range": ("fill_pct", lambda c: ~c.between(-50, 150)), "negative_label": ("time_to_overflow_hours", lambda c: c < 0),
        "unknown_risk": ("risk_level", lambda c: ~F.coalesce(c.isin("Critical", "High", "Medium", "Low"), F.lit(False))), **{f"{f}_null": (f, lambda c: c.isNull()) for f in FEATURES},
    }
    checks = {"rows": F.count(F.lit(1)), "missing_columns": F.max(F.lit(len(needed) - len(have))).cast("long")} | {k: F.count_if(f(F.col(c))) for k, (c, f) in bad.items() if c in have}
    one = df.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in checks])).alias("x")).select("x.*")
