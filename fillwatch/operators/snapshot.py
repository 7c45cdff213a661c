"""Point-in-time forecasts: what was known of every configured bin at a decision time, with an explicit status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.operators.features import BY, FEATURES, HOUR, build_feature_table, dedup_last, us
from fillwatch.operators.labels import THRESHOLD, naive_forecast, risk_level

HORIZONS, SUPPORTED, MAX_STALENESS = (6, 24, 48, 168), (90.0,), 72.0
ESTIMATE, SCHEMA_VERSION = "expected_hours_to_service_threshold", "2.0"


def instant(text: str) -> Column:
    """An ISO time with or without offset (then UTC)."""
    return F.lit(text).cast("timestamp")


def known_at(log: DataFrame, decision_at: Column, receipts: bool = True) -> DataFrame:
    """Readings observed, and where receipts are recorded received, by the decision time; null times drop the row."""
    out = log.where(F.col("ts") <= decision_at)
    return out.where(F.col("received_at") <= decision_at) if receipts and "received_at" in log.columns else out


def resolve_bins(bins: DataFrame | list[str] | None, log: DataFrame) -> DataFrame:
    """The configured bins: a table's or a list's distinct ids as text, else those of the log."""
    if isinstance(bins, DataFrame):
        return bins.select(F.col("bin_id").cast("string").alias("bin_id")).distinct()
    if bins is not None:
        return log.sparkSession.createDataFrame([(str(b),) for b in bins], "bin_id string").distinct()
    return log.where("bin_id IS NOT NULL").select("bin_id").distinct()


def horizons(fill: Column, rate: Column, hours: tuple[int, ...] = HORIZONS) -> Column:
    """Array of projections at a constant rate (not below 0): growth uncapped, level at most 100; never a probability."""
    grow = F.greatest(F.lit(0.0), rate)
    return F.transform(F.array(*map(F.lit, hours)), lambda h: F.struct(
        h.alias("horizon_hours"), F.round(F.least(F.lit(100.0), fill + grow * h), 1).alias("expected_fill_pct"), F.round(grow * h, 1).alias("expected_growth_pct_points"),
        F.lit(None).cast("double").alias("overflow_probability"), F.lit("unsupported").alias("overflow_probability_status"),
    ))


def by_horizon(h: Column) -> Column:
    """Projections as a map keyed by the hours as text."""
    return F.map_from_entries(F.transform(h, lambda x: F.struct(x["horizon_hours"].cast("string"), x)))


Scorer = Callable[[DataFrame], DataFrame]


def naive(fallback_hours: float = 168.0) -> Scorer:
    """The rule-based scorer; adds `hours`."""
    return lambda latest: naive_forecast(latest, fallback_hours).withColumnRenamed("naive_hours", "hours")


def known_pairs(log: DataFrame, decisions: list[str]) -> DataFrame:
    """What was known of each bin at each decision time: its counts so far and its newest reading with all features.

    One scan and one exchange, by bin, whatever the number of decisions. A reading becomes visible at the later of its own
    and its receipt's time; it is late for the decisions between the two. A bin without late readings at a decision needs
    no features of its own there: features look back only, so the newest reading's are those of the whole log. Only for
    decisions at which a bin has late readings are the bin's visible ones copied and computed apart, in the same
    partition. Without a level or a time in the log there are no features.
    """
    columns, usable = set(log.columns), {"fill_pct", "ts"} <= set(log.columns)
    marks = F.array(*[F.unix_micros(instant(d)) for d in decisions])
    x = log.where("bin_id IS NOT NULL").withColumns({"bin_id": F.col("bin_id").cast("string"), "_us": us() if "ts" in columns else F.lit(0).cast("long")})
    x = x.withColumn("_seen_us", F.when(F.col("received_at").isNotNull(), F.greatest("_us", us("received_at"))) if "received_at" in columns else F.col("_us"))
    x = x.where(F.col("_seen_us") <= F.array_max(marks))  # before any window: no decision sees the rest
    if "received_at" in columns and len(decisions) > 1:
        late = F.filter(marks, lambda d: (F.col("_us") <= d) & (d < F.col("_seen_us")))
        x = x.withColumn("_late", F.array_distinct(F.flatten(F.collect_set(late).over(Window.partitionBy("bin_id")))))
        x = x.withColumn("_at", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.filter("_late", lambda d: F.col("_seen_us") <= d))))
        by = ("bin_id", "_at")
    else:
        x, by = x.withColumns({"_late": F.array().cast("array<bigint>"), "_at": F.lit(None).cast("long")}), BY
    order = Window.partitionBy(*by).orderBy("_us", "seq")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    low = F.coalesce(F.col("confidence_flag") == 0, F.lit(False)) if "confidence_flag" in columns else F.lit(False)
    x = x.withColumns({"n_raw": F.count(F.lit(1)).over(run), "all_low": F.min(low).over(run), "_until": F.lead("_us").over(order), "first_waste": F.first("waste_type", ignorenulls=True).over(run) if "waste_type" in columns else F.lit(None).cast("string")})
    x = build_feature_table(x, by) if usable else dedup_last(x, by).withColumns({c: F.lit(None).cast("double") for c in FEATURES if c not in columns})
    mine = F.when(F.col("_at").isNotNull(), F.when(F.col("_until").isNull(), F.array("_at")))
    mine = mine.otherwise(F.filter(marks, lambda d: (F.col("_us") <= d) & (F.col("_until").isNull() | (d < F.col("_until"))) & ~F.array_contains("_late", d)))
    flag = F.col("confidence_flag").cast("int") if "confidence_flag" in columns else F.lit(1)
    keep = [F.col(c) for c in ("n_raw", "all_low", "first_waste")]
    return x.select("bin_id", F.explode(mine).alias("decision_us"), F.col("ts") if "ts" in columns else F.lit(None).cast("timestamp").alias("ts"), *keep, (flag if usable else F.lit(None).cast("int")).alias("flag"), *FEATURES)


def _forecasts(log: DataFrame, decisions: list[str], wanted: DataFrame | None, threshold: float, max_staleness_hours: float, available_after: str | None, scorer: Scorer | None, snapshot_id: str | None, model_version: str, model_sha256: str | None) -> DataFrame:
    """Every wanted bin (None: those known) at every decision time, with its status and forecast."""
    usable = {"fill_pct", "ts"} <= set(log.columns)
    known = known_pairs(log, decisions)
    known = (scorer or naive())(known) if usable else known.withColumn("hours", F.lit(None).cast("double"))
    out = known
    if wanted is not None:
        pairs = wanted.select("bin_id", F.explode(F.array(*[F.unix_micros(instant(d)) for d in decisions])).alias("decision_us"))
        out = pairs.hint("merge").join(known, ["bin_id", "decision_us"], "left")
    finite = F.col("hours").isNotNull() & ~F.isnan("hours") & (F.abs("hours") != float("inf")) & (F.col("hours") >= 0)
    early = F.lit(False) if available_after is None else F.col("decision_us") < F.unix_micros(instant(available_after))
    status = (
        F.when(early, "model_unavailable").when(F.col("n_raw").isNull(), "unavailable").when(~F.lit(threshold).isin(*SUPPORTED), "unsupported_threshold").when(F.lit(not usable), "missing_required_columns")
        .when(~finite, "model_error").when(F.col("all_low"), "low_confidence").when(F.col("n_raw") <= 1, "cold_start").otherwise("available")
    )
    age = (F.col("decision_us") - us()) / HOUR
    out = out.withColumn("_s", status).withColumn("_kept", F.col("_s").isin("low_confidence", "cold_start", "available")).withColumn("_old", F.col("_kept") & (age > max_staleness_hours))
    # beside the rounded level below, a lambda's `fill_pct` would be taken for it
    out = out.withColumn("_horizons", by_horizon(horizons(F.col("fill_pct"), F.col("fill_rate_1h"))))
    reason = F.when(F.col("_s") == "model_unavailable", F.lit(f"decision before {available_after}")).when(F.col("_s") == "unsupported_threshold", F.lit(f"threshold {threshold} is not supported")).when(F.col("_old"), F.format_string(f"latest reading is %.1f h old (at most {max_staleness_hours})", age))
    kept = lambda c: F.when(F.col("_kept"), c)
    seen = lambda c: F.when(~F.col("_s").isin("unavailable", "model_unavailable"), c)
    level = F.when(F.col("_s") == "unsupported_threshold", F.col("fill_pct")).when(F.col("_kept") | (F.col("_s") == "model_error"), F.round("fill_pct", 1))
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "bin_id", seen(F.col("ts")).alias("timestamp"), F.when(F.col("_old"), "stale").otherwise(F.col("_s")).alias("status"), reason.alias("reason"),
        kept(F.round("hours", 2)).alias("time_to_service_threshold_hours"), kept(risk_level(F.col("hours"))).alias("risk_level"), level.alias("fill_pct"), F.coalesce(seen(F.col("flag")), F.lit(0)).alias("confidence_flag"),
        F.lit(threshold).alias("target_threshold_pct"), F.lit(ESTIMATE).alias("estimate_type"), F.lit(model_version).alias("model_version"), F.lit(model_sha256).cast("string").alias("model_sha256"), seen(F.col("first_waste")).alias("waste_type"),
        F.lit(False).alias("waste_type_used_as_feature"), F.timestamp_micros("decision_us").alias("decision_at"), F.lit(snapshot_id).cast("string").alias("input_snapshot_id"), kept(F.col("_horizons")).alias("horizons"),
    )


def snapshot(log: DataFrame, decision_at: str, bins: DataFrame | list[str] | None = None, threshold: float = THRESHOLD, max_staleness_hours: float = MAX_STALENESS, available_after: str | None = None, scorer: Scorer | None = None, snapshot_id: str | None = None, model_version: str = "naive", model_sha256: str | None = None) -> DataFrame:
    """One row per configured bin. The filter comes before any window, so later rows can't change the result.

    Status, first match: model_unavailable, unavailable, unsupported_threshold, missing_required_columns, model_error,
    low_confidence, cold_start, available; of the last three, those older than max_staleness_hours turn stale and keep
    their prediction. Without any bin there is one row with a null id from snapshot_or_none (invalid_input). Counts,
    flags and features come from the same windows: one exchange of the log.
    """
    gated = available_after is not None and log.sparkSession.range(1).select((instant(decision_at) < instant(available_after)).alias("x")).first()[0]
    wanted = resolve_bins(bins, log) if bins is not None or gated else None
    return _forecasts(log, [decision_at], wanted, threshold, max_staleness_hours, available_after, scorer, snapshot_id, model_version, model_sha256)


def _or_none(out: DataFrame, bins: DataFrame) -> DataFrame:
    """With a single row of a null id and status invalid_input where there is no bin."""
    empty = out.sparkSession.range(1).select(F.lit("invalid_input").alias("_status"))
    none = empty.join(bins.select(F.lit(1).alias("one")).limit(1), how="left_anti", on=F.lit(True))
    cols = [F.col("_status").alias(f.name) if f.name == "status" else F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]
    return out.unionByName(none.select(*cols))


def snapshot_or_none(log: DataFrame, decision_at: str, **options) -> DataFrame:  # noqa: ANN003
    """snapshot(), with the single null-id row where there is no bin at all."""
    there = resolve_bins(options.get("bins"), known_at(log, instant(decision_at)))
    return _or_none(snapshot(log, decision_at, **options), there)


def snapshot_grid(log: DataFrame, decisions: list[str], bins: DataFrame | list[str] | None = None, threshold: float = THRESHOLD, max_staleness_hours: float = MAX_STALENESS, available_after: str | None = None, scorer: Scorer | None = None, snapshot_id: str | None = None, model_version: str = "naive", model_sha256: str | None = None) -> DataFrame:
    """snapshot() at several decision times in one plan: every configured bin (None: every bin of the log) at each, all statuses, one scan of the log (see known_pairs)."""
    wanted = resolve_bins(bins, log)
    return _or_none(_forecasts(log, decisions, wanted, threshold, max_staleness_hours, available_after, scorer, snapshot_id, model_version, model_sha256), wanted)
