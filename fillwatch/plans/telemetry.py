"""Registered queries over the sensor log, each with differently written SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.operators import features as X
from fillwatch.operators import kpi
from fillwatch.operators import labels as L
from fillwatch.operators import snapshot as S
from fillwatch.operators.chunked import build_feature_table_chunked
from fillwatch.operators.quantiles import exact_percentiles
from fillwatch.session import shared_dir, stored
from fillwatch.sources import readers as I
from fillwatch.sources.adapters import READINGS_DUP_SQL, READINGS_SQL, TEST_FROM, VAL_FROM, readings, readings_dup

DECISION = "2024-01-26T12:00:00Z"
EXACT = ("time_since_reset_hours", "time_to_overflow_hours")


def key() -> list:
    return [F.col("bin_id"), X.us().alias("us")]


def r6(*cols: str) -> list:
    """Rounded for comparison, without minus zero; elapsed hours are quotients of integers and need none."""
    return [F.col(c) if c in EXACT else (F.round(c, 6) + 0.0).alias(c) for c in cols]


def feats(spark: SparkSession, d: str) -> DataFrame:
    return X.build_feature_table(readings_dup(spark, d))


def labeled(spark: SparkSession, d: str, drop: bool = True) -> DataFrame:
    return L.build_labels(feats(spark, d), drop)


def split(spark: SparkSession, d: str) -> DataFrame:
    return L.chronological_split(labeled(spark, d), VAL_FROM, TEST_FROM)


# The SQL below joins where the operators use frames: it is meant to be another way to the same rows.
DEDUP = READINGS_DUP_SQL + ", dd AS (SELECT * FROM readings_dup QUALIFY row_number() OVER (PARTITION BY bin_id, us ORDER BY seq DESC) = 1)"
RATES = """, st AS (SELECT *, fill_pct - lag(fill_pct) OVER w AS step, us - lag(us) OVER w AS dt FROM dd WINDOW w AS (PARTITION BY bin_id ORDER BY us)),
sg AS (SELECT *, sum(CASE WHEN step < -30 THEN 1 ELSE 0 END) OVER (PARTITION BY bin_id ORDER BY us) AS seg FROM st),
pr AS (SELECT a.bin_id, a.us, b.fill_pct AS bf, (a.us - b.us) / 1e6 AS s FROM sg a JOIN sg b ON a.bin_id = b.bin_id AND a.seg = b.seg AND b.us < a.us AND a.us - b.us <= 32400000000),
one AS (SELECT * FROM pr WHERE s BETWEEN 900 AND 7200 QUALIFY row_number() OVER (PARTITION BY bin_id, us ORDER BY abs(s - 3600), s) = 1),
six AS (SELECT * FROM pr WHERE s BETWEEN 5400 AND 32400 QUALIFY row_number() OVER (PARTITION BY bin_id, us ORDER BY abs(s - 21600), s) = 1),
raw AS (SELECT sg.*, CASE WHEN one.s IS NOT NULL THEN (fill_pct - one.bf) / (one.s / 3600) WHEN dt BETWEEN 60000000 AND 86400000000 AND step >= -30 THEN step / (dt / 3.6e9) ELSE 0 END AS r1,
  six.s AS s6, six.bf AS f6 FROM sg LEFT JOIN one USING (bin_id, us) LEFT JOIN six USING (bin_id, us)),
rt AS (SELECT *, greatest(-50, least(50, r1)) AS fill_rate_1h, greatest(-50, least(50, CASE WHEN s6 IS NOT NULL THEN (fill_pct - f6) / (s6 / 3600) ELSE r1 END)) AS fill_rate_6h FROM raw)"""
RESETS = """, dr AS (SELECT *, coalesce(step < -35, false) AS isdrop FROM {src}),
cy AS (SELECT *, CAST(sum(CASE WHEN isdrop THEN 1 ELSE 0 END) OVER (PARTITION BY bin_id ORDER BY us) AS BIGINT) AS cycle_id FROM dr),
rs AS (SELECT *, (us - min(us) OVER (PARTITION BY bin_id, cycle_id)) / 3.6e9 AS time_since_reset_hours FROM cy)"""
SLOT = """, da AS (SELECT bin_id, hour(ts) AS h, CAST(ts AS DATE) AS d, avg(fill_rate_1h) AS m FROM rs GROUP BY ALL),
hi AS (SELECT a.bin_id, a.h, a.d, avg(b.m) AS hist FROM da a JOIN da b ON a.bin_id = b.bin_id AND a.h = b.h AND b.d < a.d GROUP BY ALL),
ft AS (SELECT rs.*, coalesce(hi.hist, fill_rate_1h) AS hist_avg_rate_same_slot, sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_sin, cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_cos,
  sin(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7) AS dow_sin, cos(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7) AS dow_cos, CASE WHEN (dayofweek(ts) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend
  FROM rs LEFT JOIN hi ON rs.bin_id = hi.bin_id AND hour(rs.ts) = hi.h AND CAST(rs.ts AS DATE) = hi.d)"""
FEATURES = DEDUP + RATES + RESETS.format(src="rt") + SLOT
LABELS = FEATURES + """, cr AS (SELECT bin_id, cycle_id, min(us) AS crossing_us FROM ft WHERE fill_pct >= 90 GROUP BY ALL),
lb AS (SELECT ft.*, crossing_us, CASE WHEN crossing_us IS NOT NULL THEN greatest(0, (crossing_us - us) / 3.6e9) END AS hours FROM ft LEFT JOIN cr USING (bin_id, cycle_id)),
lab AS (SELECT *, CASE WHEN hours < 4 THEN 'Critical' WHEN hours < 12 THEN 'High' WHEN hours < 24 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN ts < TIMESTAMP '%s' THEN 'train' WHEN ts < TIMESTAMP '%s' THEN 'val' ELSE 'test' END AS split FROM lb WHERE hours IS NOT NULL)""" % (VAL_FROM, TEST_FROM)
LEAK = f"(split = 'train' AND crossing_us > epoch_us(TIMESTAMP '{VAL_FROM}') OR split = 'val' AND crossing_us > epoch_us(TIMESTAMP '{TEST_FROM}'))"
FEATURE_COLS = ["fill_pct", "fill_rate_1h", "fill_rate_6h", "hist_avg_rate_same_slot", "time_since_reset_hours", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
R6 = lambda *cols: ", ".join(c if c in EXACT else f"round({c}, 6) + 0.0 AS {c}" for c in cols)
DEC = "TIMESTAMP '2024-01-26 12:00:00'"
PIT = READINGS_DUP_SQL.replace("readings_dup AS", "rd0 AS") + f", readings_dup AS (SELECT * FROM rd0 WHERE us <= epoch_us({DEC}) AND rec_us <= epoch_us({DEC}))"
PIT_FEATURES = PIT + FEATURES[len(READINGS_DUP_SQL):]
SNAP = PIT_FEATURES + f""", nw AS (SELECT bin_id, count(*) AS n_raw, bool_and(confidence_flag = 0) AS all_low, arg_min(waste_type, us) AS waste_type FROM readings_dup GROUP BY bin_id),
lt AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1),
bins AS (SELECT DISTINCT bin_id FROM readings UNION SELECT 'BIN-NONE'),
sn AS (SELECT bins.bin_id, CASE WHEN n_raw IS NULL THEN 'unavailable' WHEN (epoch_us({DEC}) - us) / 3.6e9 > 72 THEN 'stale' WHEN all_low THEN 'low_confidence' WHEN n_raw <= 1 THEN 'cold_start' ELSE 'available' END AS status,
  us, fill_pct, fill_rate_1h, nw.waste_type, confidence_flag, least(200, CASE WHEN fill_rate_1h = 0 THEN 168.0 ELSE greatest(90 - fill_pct, 0) / abs(fill_rate_1h) END) AS hours
  FROM bins LEFT JOIN nw USING (bin_id) LEFT JOIN lt USING (bin_id))"""


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    log = readings_dup(spark, d)
    bins = readings(spark, d).select("bin_id").distinct().union(spark.range(1).select(F.lit("BIN-NONE")))
    return S.snapshot(log, DECISION, bins, snapshot_id="snap-1")


def soonest(spark: SparkSession, d: str) -> DataFrame:
    """Which bins reach the threshold first, as known at the decision time?"""
    x = _snapshot(spark, d)
    return x.select("bin_id", "status", X.us("timestamp").alias("us"), "fill_pct", F.round("time_to_service_threshold_hours", 2).alias("hours"), "risk_level", "waste_type", "confidence_flag")


def _risk(h: str) -> str:
    return f"CASE WHEN {h} IS NULL THEN NULL WHEN {h} < 4 THEN 'Critical' WHEN {h} < 12 THEN 'High' WHEN {h} < 24 THEN 'Medium' ELSE 'Low' END"


def _horizons(spark: SparkSession, d: str) -> DataFrame:
    f = X.latest_per_bin(feats(spark, d))
    x = f.select("bin_id", F.explode(S.horizons(F.col("fill_pct"), F.col("fill_rate_1h"))).alias("h"))
    return x.select("bin_id", F.col("h.horizon_hours").cast("long").alias("horizon_hours"), F.round("h.expected_fill_pct", 1).alias("expected_fill_pct"), F.round("h.expected_growth_pct_points", 1).alias("expected_growth_pct_points"), F.col("h.overflow_probability").isNull().alias("no_probability"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Scored by rule: the naive forecast and two constants, on the purged test split."""
    x = L.purge_label_leakage(split(spark, d), VAL_FROM, TEST_FROM).where("split = 'test'")
    x = L.naive_forecast(x)
    cols = ["time_to_overflow_hours"]
    long = x.select(*cols, F.explode(F.array(F.struct(F.lit("naive").alias("model"), F.col("naive_hours").alias("p")), F.struct(F.lit("always_6").alias("model"), F.lit(6.0).alias("p")), F.struct(F.lit("always_24").alias("model"), F.lit(24.0).alias("p")))).alias("m"))
    return L.evaluate(long.select(*cols, "m.model", F.col("m.p").alias("predicted_hours")))


EVAL_SQL = LABELS + f""", te AS (SELECT *, greatest(90 - fill_pct, 0) AS rem FROM lab WHERE split = 'test' AND NOT {LEAK}), mx AS (SELECT max(rem) AS m FROM te),
nv AS (SELECT hours, 'naive' AS model, greatest(0, least(200, CASE WHEN fill_rate_1h = 0 THEN m ELSE rem / abs(fill_rate_1h) END)) AS p FROM te, mx UNION ALL SELECT hours, 'always_6', 6.0 FROM te UNION ALL SELECT hours, 'always_24', 24.0 FROM te),
ev AS (SELECT model, p - hours AS e, {_risk('hours')} AS rt, {_risk('p')} AS rp FROM nv)
SELECT model, round(avg(abs(e)), 3) AS mae_hours, round(sqrt(avg(e * e)), 3) AS rmse_hours, round(avg(CASE WHEN rt = rp THEN 1.0 ELSE 0.0 END), 3) AS risk_accuracy,
 round(coalesce(count(*) FILTER (WHERE rt = 'Critical' AND rp = 'Critical') / nullif(count(*) FILTER (WHERE rt = 'Critical'), 0), 0), 3) AS critical_recall, count(*) AS n_rows FROM ev GROUP BY model"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return L.quality_report(labeled(spark, d))


def _label_summary(spark: SparkSession, d: str) -> DataFrame:
    c = "time_to_overflow_hours"
    hours = stored(labeled(spark, d).select(c), "hours")
    quarters = dict(zip(("q25", "q50", "q75"), exact_percentiles(hours, c, [0.25, 0.5, 0.75]), strict=True))
    x = hours.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")).withColumns({k: F.lit(v).cast("double") for k, v in quarters.items()})
    return x.select("n", *r6("mean", "std", "lo", "q25", "q50", "q75", "hi"))


#: Thirty decision times, 20 hours and 7 minutes apart.
DECISIONS = [f"{datetime(2024, 1, 4) + k * timedelta(hours=20, minutes=7):%Y-%m-%dT%H:%M:%SZ}" for k in range(30)]


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("bin_id").distinct().union(spark.range(1).select(F.lit("BIN-NONE")))


def _flat(x: DataFrame) -> DataFrame:
    """All columns of a forecast, times as numbers and projections as text."""
    h = F.array_join(F.transform(F.array(*[F.lit(str(k)) for k in S.HORIZONS]), lambda k: F.concat_ws(":", k, F.col("horizons")[k]["expected_fill_pct"].cast("decimal(9,1)"), F.col("horizons")[k]["expected_growth_pct_points"].cast("decimal(9,1)"), F.col("horizons")[k]["overflow_probability_status"])), ",")
    return x.select(F.unix_micros("decision_at").alias("decision_us"), X.us("timestamp").alias("us"), F.when(F.col("horizons").isNotNull(), h).alias("horizons"), *[c for c in x.columns if c not in ("decision_at", "timestamp", "horizons")])


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Late receipts and thirty decisions, with a scorer of its own: hours to the threshold at the 6 h rate."""
    def scorer(x: DataFrame) -> DataFrame:
        return x.withColumn("hours", F.when(F.col("fill_rate_6h") > 0, F.greatest(F.lit(0.0), 90 - F.col("fill_pct")) / F.col("fill_rate_6h")).when(F.col("fill_rate_6h") == 0, 168.0).otherwise(-1.0))

    return _flat(S.snapshot_grid(readings_dup(spark, d), DECISIONS, _bins(spark, d), available_after=DECISIONS[2], scorer=scorer, snapshot_id="grid-1", model_version="six-hour", model_sha256="0" * 64))


def _grid_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Every status by what brings it about, at five decisions."""
    log, bins, some = readings_dup(spark, d), _bins(spark, d), DECISIONS[::7]
    cases = {
        "plain": S.snapshot_grid(log, some, bins), "threshold": S.snapshot_grid(log, some, bins, threshold=75.0), "columns": S.snapshot_grid(log.drop("fill_pct"), some, bins), "early": S.snapshot_grid(log, some, available_after=some[2]),
        "scorer": S.snapshot_grid(log, some, bins, scorer=lambda x: x.withColumn("hours", F.lit(float("nan")))), "no_bins": S.snapshot_grid(log.where("false"), some),
    }
    rows = None
    for name, x in cases.items():
        x = x.select(F.lit(name).alias("case_name"), F.unix_micros("decision_at").alias("decision_us"), "status", "bin_id", "time_to_service_threshold_hours", "fill_pct")
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("case_name", "decision_us", "status").agg(F.count(F.lit(1)).alias("n"), F.count("bin_id").alias("n_bins"), F.count("time_to_service_threshold_hours").alias("n_hours"), F.count("fill_pct").alias("n_fill"))


def _stops(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as stops of the daily route at a bin."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'")
    return e.select(F.col("event_id").alias("stop_id"), F.format_string("BIN-%03d", "user_id").alias("bin_id"), (F.unix_micros(F.col("ts").cast("timestamp")) + 1).alias("us"), F.date_format("ts", "yyyyMMdd").alias("route"))


STOPS_SQL = "stops AS (SELECT event_id AS stop_id, 'BIN-' || format('{:03d}', user_id) AS bin_id, epoch_us(ts) + 1 AS us, strftime(ts, '%Y%m%d') AS route FROM events WHERE event_type = 'click')"

def _at(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _read_csv(spark: SparkSession, d: str) -> DataFrame:
    """The log written as CSV files and read as such."""
    readings(spark, d).write.csv(at := _at(spark, "log"), header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return I.read_readings(spark, at, "csv").select(*key(), "seq", "fill_pct", "confidence_flag", "waste_type", X.us("received_at").alias("rec_us"))


def _read_plain(spark: SparkSession, d: str) -> DataFrame:
    """A log without receipts, flags and kinds: nothing is filtered by receipt, and all readings count as good."""
    readings_dup(spark, d).select("bin_id", "ts", "fill_pct", "seq").write.parquet(at := _at(spark, "plain"))
    return S.snapshot(I.read_readings(spark, at), DECISION).select("bin_id", "status", X.us("timestamp").alias("us"), "fill_pct", "confidence_flag", "waste_type")


def _stage(spark: SparkSession, d: str) -> DataFrame:
    """The feature table as a stage output, of which one day is read again."""
    I.write_stage(feats(spark, d), at := _at(spark, "stage"))
    return spark.read.parquet(at).where(F.col("event_date") == F.lit(VAL_FROM).cast("date")).select(*key(), "cycle_id", *r6("fill_pct", "fill_rate_1h"))


def _stage_table(spark: SparkSession, d: str) -> DataFrame:
    """The feature table as a stage bucketed by bin, of which labels are made without an exchange."""
    name = f"stage_{uuid.uuid4().hex}"
    return L.label_cycles(I.write_stage_table(feats(spark, d), name, _at(spark, "bucketed"), 8))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    I.write_metrics(_models(spark, d), at := _at(spark, "metrics"))
    return spark.read.json(at).select("model", "mae_hours", "rmse_hours", "n_rows")


W, SEL = "WITH ", "SELECT "
QUERIES = {
    "read_log_csv": _read_csv,
    "read_log_plain": _read_plain,
    "stage_output": _stage,
    "metrics_output": _metrics,
    "stage_table": lambda s, d: _stage_table(s, d).select(*key(), X.us("crossing_ts").alias("crossing_us"), *r6("time_to_overflow_hours")),
    "feature_table_chunked": lambda s, d: build_feature_table_chunked(readings_dup(s, d), 2).select(*key(), "cycle_id", "is_weekend", *r6(*FEATURE_COLS)),
    "scan_readings": lambda s, d: readings(s, d).select(*key(), "seq", "fill_pct", "confidence_flag", "waste_type", X.us("received_at").alias("rec_us")),
    "time_features": lambda s, d: X.add_time_features(readings(s, d)).select(*key(), "seq", *r6("hour_sin", "hour_cos", "dow_sin", "dow_cos"), "is_weekend"),
    "utc_equivalence": lambda s, d: readings(s, d).withColumn("text", F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))).select("seq", F.unix_micros(F.try_to_timestamp("text")).alias("us")),
    "pit_filter": lambda s, d: S.known_at(readings(s, d), S.instant(DECISION)).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")),
    "dedup_last": lambda s, d: X.dedup_last(readings_dup(s, d)).select(*key(), "seq", F.round("fill_pct", 6).alias("fill_pct")),
    "nearest_lookback": lambda s, d: X.add_rate_features(readings_dup(s, d)).select(*key(), *r6("fill_rate_1h", "fill_rate_6h")),
    "reset_cycles": lambda s, d: X.add_reset_features(X.dedup_last(readings_dup(s, d))).select(*key(), "cycle_id", *r6("time_since_reset_hours")),
    "slot_history": lambda s, d: X.add_slot_history(X.add_rate_features(readings_dup(s, d))).select(*key(), *r6("hist_avg_rate_same_slot")),
    "feature_table": lambda s, d: feats(s, d).select(*key(), "cycle_id", "is_weekend", *r6(*FEATURE_COLS)),
    "latest_per_bin": lambda s, d: X.latest_per_bin(feats(s, d)).select(*key(), "cycle_id", *r6("fill_pct", "fill_rate_1h", "hist_avg_rate_same_slot")),
    "head_per_bin": lambda s, d: X.head_per_bin(readings(s, d), 5).select("bin_id", "seq"),
    "episode_context": lambda s, d: X.episode_context(readings(s, d)).select("bin_id", "seq", F.col("row").cast("long").alias("row")),
    "label_cycles": lambda s, d: L.label_cycles(feats(s, d)).select(*key(), X.us("crossing_ts").alias("crossing_us"), *r6("time_to_overflow_hours")),
    "risk_level": lambda s, d: labeled(s, d, False).select(*key(), "risk_level"),
    "risk_distribution": lambda s, d: labeled(s, d).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")),
    "label_summary": _label_summary,
    "censor_drop": lambda s, d: L.label_cycles(feats(s, d)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("time_to_overflow_hours").isNull()).alias("n_censored"), F.count_distinct("bin_id").alias("n_bins")),
    "chrono_split": lambda s, d: split(s, d).select(*key(), "split"),
    "purge_leakage": lambda s, d: split(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(L.leaks_label(VAL_FROM, TEST_FROM)).alias("n_purged")),
    "null_counts": lambda s, d: feats(s, d).agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in X.FEATURES]),
    "quality_checks": _quality,
    "low_confidence_bins": lambda s, d: readings(s, d).groupBy("bin_id", F.to_date("ts").cast("string").alias("day")).agg(F.min(F.coalesce(F.col("confidence_flag") == 0, F.lit(False))).alias("all_low"), F.min_by("waste_type", F.struct("ts", "seq")).alias("first_waste")).where("all_low"),
    "naive_forecast": lambda s, d: L.naive_forecast(X.latest_per_bin(feats(s, d))).select(*key(), *r6("naive_hours")),
    "horizons": _horizons,
    "eval_metrics": _models,
    "select_model": lambda s, d: L.select_model(_models(s, d), ["always_24", "always_6", "naive"]).select("model", "mae_hours"),
    "snapshot": soonest,
    "forecast_status": lambda s, d: _snapshot(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "model_unavailable": lambda s, d: S.snapshot(readings(s, d), "2024-01-10T00:00:00Z", available_after=TEST_FROM).select("bin_id", "status", "time_to_service_threshold_hours", "risk_level"),
    "unsupported_threshold": lambda s, d: S.snapshot(readings(s, d), DECISION, threshold=100.0).select("bin_id", "status", "fill_pct", "time_to_service_threshold_hours"),
    "bin_coverage": lambda s, d: _snapshot(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("bin_id").alias("n_bins"), F.count_if(F.col("status") == "unavailable").alias("n_unavailable")),
    "resolve_bins": lambda s, d: S.resolve_bins(None, S.known_at(readings(s, d), S.instant("2024-01-02T00:00:00Z"))),
    "snapshot_grid": _grid,
    "grid_statuses": _grid_statuses,
    "kpi_overflow": lambda s, d: kpi.overflow_incidents(readings(s, d)).select(F.col("day").cast("string").alias("day"), "overflowed", "bins"),
    "unnecessary_trips": lambda s, d: kpi.unnecessary_trips(_stops(s, d), readings(s, d)),
    "colour_band": lambda s, d: readings(s, d).select("seq", kpi.colour(F.col("fill_pct")).alias("colour")),
    "sensor_alerts": lambda s, d: kpi.sensor_alerts(readings(s, d)).groupBy("bin_id", "alert").agg(F.count(F.lit(1)).alias("n")),
    "fill_at_pickup": lambda s, d: kpi.fill_at_pickup(readings(s, d)).select("bin_id", "pickups", F.round("mean_fill", 6).alias("mean_fill")),
    "priority_rank": lambda s, d: kpi.priority(X.latest_per_bin(feats(s, d)).select("bin_id", F.col("waste_type").alias("area"), (F.col("fill_pct") / 100).alias("fill"), (F.abs("fill_rate_1h") / 50).alias("rate"), F.col("confidence_flag").cast("double").alias("sure")), {"fill": 0.6, "rate": 0.3, "sure": 0.1}).select("bin_id", "area", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place")),
}

SQL_TIMES = [t[:-1].replace("T", " ") for t in DECISIONS]
#: For every bin and decision time what was known of it: the features' SQL over one copy of the log for each decision.
KEYED = "rd1 AS (SELECT rd0.* REPLACE (bin_id || '@' || d AS bin_id) FROM rd0, (SELECT unnest([" + ", ".join(f"epoch_us(TIMESTAMP '{t}')" for t in SQL_TIMES) + "]) AS d) WHERE us <= d AND rec_us <= d), readings_dup AS (SELECT * FROM rd1)"
GRID = READINGS_DUP_SQL.replace("readings_dup AS", "rd0 AS") + ", " + KEYED + FEATURES[len(READINGS_DUP_SQL):] + f""", nw AS (SELECT bin_id, count(*) AS n_raw, bool_and(confidence_flag = 0) AS all_low, arg_min(waste_type, us) AS first_waste FROM readings_dup GROUP BY bin_id),
lt AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1),
grid AS (SELECT b.bin_id, d, n_raw, all_low, first_waste AS waste_type, us, fill_pct, fill_rate_1h, fill_rate_6h, confidence_flag FROM (SELECT DISTINCT bin_id FROM readings UNION SELECT 'BIN-NONE') AS b, (SELECT unnest([{', '.join(f"epoch_us(TIMESTAMP '{t}')" for t in SQL_TIMES)}]) AS d)
  LEFT JOIN nw ON nw.bin_id = b.bin_id || '@' || d LEFT JOIN lt ON lt.bin_id = b.bin_id || '@' || d)"""
HR = ["(6)", "(24)", "(48)", "(168)"]
ORACLES = {
    "read_log_csv": f"WITH {READINGS_SQL} SELECT bin_id, us, seq, fill_pct, confidence_flag, waste_type, rec_us FROM readings",
    "read_log_plain": f"WITH {DEDUP.replace('FROM readings_dup QUALIFY', f'FROM readings_dup WHERE us <= epoch_us({DEC}) QUALIFY')}, n AS (SELECT bin_id, count(*) AS n FROM readings_dup WHERE us <= epoch_us({DEC}) GROUP BY bin_id) SELECT bin_id, CASE WHEN (epoch_us({DEC}) - max(us)) / 3.6e9 > 72 THEN 'stale' WHEN any_value(n) <= 1 THEN 'cold_start' ELSE 'available' END AS status, max(us) AS us, round(arg_max(fill_pct, us), 1) AS fill_pct, 1 AS confidence_flag, CAST(NULL AS VARCHAR) AS waste_type FROM dd JOIN n USING (bin_id) GROUP BY bin_id",
    "stage_output": f"WITH {FEATURES} SELECT bin_id, us, cycle_id, {R6('fill_pct', 'fill_rate_1h')} FROM ft WHERE CAST(ts AS DATE) = DATE '{VAL_FROM}'",
    "metrics_output": "SELECT model, mae_hours, rmse_hours, n_rows FROM (WITH " + EVAL_SQL + ")",
    "scan_readings": f"WITH {READINGS_SQL} SELECT bin_id, us, seq, fill_pct, confidence_flag, waste_type, rec_us FROM readings",
    "time_features": f"WITH {READINGS_SQL} SELECT bin_id, us, seq, round(sin(2*pi()*(hour(ts)+minute(ts)/60.0)/24), 6) + 0.0 AS hour_sin, round(cos(2*pi()*(hour(ts)+minute(ts)/60.0)/24), 6) + 0.0 AS hour_cos, round(sin(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_sin, round(cos(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_cos, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM readings",
    "utc_equivalence": "SELECT event_id AS seq, epoch_us(ts) AS us FROM events",
    "pit_filter": f"WITH {READINGS_SQL} SELECT bin_id, count(*) AS n, max(seq) AS last_seq FROM readings WHERE us <= epoch_us({DEC}) AND rec_us <= epoch_us({DEC}) GROUP BY bin_id",
    "dedup_last": f"WITH {READINGS_DUP_SQL} SELECT bin_id, us, max(seq) AS seq, round(arg_max(fill_pct, seq), 6) AS fill_pct FROM readings_dup GROUP BY bin_id, us",
    "nearest_lookback": f"WITH {DEDUP}{RATES} SELECT bin_id, us, {R6('fill_rate_1h', 'fill_rate_6h')} FROM rt",
    "reset_cycles": f"WITH {DEDUP}, st AS (SELECT *, fill_pct - lag(fill_pct) OVER (PARTITION BY bin_id ORDER BY us) AS step FROM dd){RESETS.format(src='st')} SELECT bin_id, us, cycle_id, {R6('time_since_reset_hours')} FROM rs",
    "slot_history": f"WITH {FEATURES} SELECT bin_id, us, {R6('hist_avg_rate_same_slot')} FROM ft",
    "feature_table": f"WITH {FEATURES} SELECT bin_id, us, cycle_id, is_weekend, {R6(*FEATURE_COLS)} FROM ft",
    "latest_per_bin": f"WITH {FEATURES} SELECT bin_id, us, cycle_id, {R6('fill_pct', 'fill_rate_1h', 'hist_avg_rate_same_slot')} FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1",
    "head_per_bin": f"WITH {READINGS_SQL} SELECT bin_id, seq FROM readings QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us, seq) <= 5",
    "episode_context": f"WITH {READINGS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY us, seq) - 1 AS row FROM readings), h AS (SELECT bin_id, min(row) AS hit FROM n WHERE fill_pct > 75 GROUP BY bin_id) SELECT n.bin_id, seq, row FROM n LEFT JOIN h USING (bin_id) WHERE CASE WHEN hit IS NULL THEN row BETWEEN 30 AND 79 ELSE row >= hit - 48 AND row <= hit END",
    "label_cycles": f"WITH {LABELS} SELECT bin_id, us, crossing_us, hours AS time_to_overflow_hours FROM lb",
    "risk_level": f"WITH {LABELS} SELECT bin_id, us, coalesce({_risk('hours')}, 'Low') AS risk_level FROM lb",
    "risk_distribution": f"WITH {LABELS} SELECT risk_level, count(*) AS n FROM lab GROUP BY risk_level",
    "label_summary": f"WITH {LABELS} SELECT count(*) AS n, round(avg(hours), 6) AS mean, round(stddev_samp(hours), 6) AS std, round(min(hours), 6) AS lo, round(quantile_cont(hours, 0.25), 6) AS q25, round(quantile_cont(hours, 0.5), 6) AS q50, round(quantile_cont(hours, 0.75), 6) AS q75, round(max(hours), 6) AS hi FROM lab",
    "censor_drop": f"WITH {LABELS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE hours IS NULL) AS n_censored, count(DISTINCT bin_id) AS n_bins FROM lb",
    "chrono_split": f"WITH {LABELS} SELECT bin_id, us, split FROM lab",
    "purge_leakage": f"WITH {LABELS} SELECT split, count(*) AS n_raw, count(*) FILTER (WHERE {LEAK}) AS n_purged FROM lab GROUP BY split",
    "null_counts": f"WITH {FEATURES} SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_null" for c in X.FEATURES) + " FROM ft",
    "quality_checks": f"WITH {LABELS} SELECT 'rows' AS check_name, count(*) AS n FROM lab UNION ALL SELECT 'missing_columns', 0 UNION ALL SELECT 'fill_out_of_range', count(*) FROM lab WHERE fill_pct NOT BETWEEN -50 AND 150 UNION ALL SELECT 'negative_label', count(*) FROM lab WHERE hours < 0 UNION ALL SELECT 'unknown_risk', count(*) FROM lab WHERE coalesce(risk_level NOT IN ('Critical', 'High', 'Medium', 'Low'), true)" + "".join(f" UNION ALL SELECT '{c}_null', count(*) FROM lab WHERE {c} IS NULL" for c in X.FEATURES),
    "low_confidence_bins": f"WITH {READINGS_SQL} SELECT bin_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, true AS all_low, arg_min(waste_type, us) AS first_waste FROM readings GROUP BY ALL HAVING max(confidence_flag) = 0",
    "naive_forecast": f"WITH {FEATURES}, l AS (SELECT *, greatest(90 - fill_pct, 0) AS rem FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1) SELECT bin_id, us, round(greatest(0, least(200, CASE WHEN fill_rate_1h = 0 THEN (SELECT max(rem) FROM l) ELSE rem / abs(fill_rate_1h) END)), 6) AS naive_hours FROM l",
    "horizons": f"WITH {FEATURES}, l AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1) SELECT bin_id, CAST(h AS BIGINT) AS horizon_hours, round(least(100, fill_pct + greatest(0, fill_rate_1h) * h), 1) AS expected_fill_pct, round(greatest(0, fill_rate_1h) * h, 1) AS expected_growth_pct_points, true AS no_probability FROM l, (VALUES {', '.join(HR)}) AS v(h)",
    "eval_metrics": "WITH " + EVAL_SQL,
    "select_model": "SELECT model, mae_hours FROM (WITH " + EVAL_SQL + ") ORDER BY mae_hours, model LIMIT 1",
    "snapshot": f"WITH {SNAP} SELECT bin_id, status, us, round(fill_pct, 1) AS fill_pct, round(hours, 2) AS hours, {_risk('hours')} AS risk_level, waste_type, coalesce(confidence_flag, 0) AS confidence_flag FROM (SELECT * REPLACE (CASE WHEN status = 'unavailable' THEN NULL ELSE hours END AS hours) FROM sn)",
    "forecast_status": f"WITH {SNAP} SELECT status, count(*) AS n FROM sn GROUP BY status",
    "model_unavailable": f"WITH {READINGS_SQL} SELECT DISTINCT bin_id, 'model_unavailable' AS status, CAST(NULL AS DOUBLE) AS time_to_service_threshold_hours, CAST(NULL AS VARCHAR) AS risk_level FROM readings",
    "unsupported_threshold": f"WITH {READINGS_SQL} SELECT bin_id, 'unsupported_threshold' AS status, arg_max(fill_pct, us) AS fill_pct, CAST(NULL AS DOUBLE) AS time_to_service_threshold_hours FROM readings WHERE us <= epoch_us({DEC}) AND rec_us <= epoch_us({DEC}) GROUP BY bin_id",
    "bin_coverage": f"WITH {SNAP} SELECT count(*) AS n_rows, count(DISTINCT bin_id) AS n_bins, count(*) FILTER (WHERE status = 'unavailable') AS n_unavailable FROM sn",
    "resolve_bins": f"WITH {READINGS_SQL} SELECT DISTINCT bin_id FROM readings WHERE us <= epoch_us(TIMESTAMP '2024-01-02') AND rec_us <= epoch_us(TIMESTAMP '2024-01-02')",
    "snapshot_grid": f"""WITH {GRID}, sc AS (SELECT g.*, CASE WHEN fill_rate_6h > 0 THEN greatest(0, 90 - fill_pct) / fill_rate_6h WHEN fill_rate_6h = 0 THEN 168.0 ELSE -1 END AS hours FROM grid AS g),
sx AS (SELECT *, CASE WHEN d < epoch_us(TIMESTAMP '{SQL_TIMES[2]}') THEN 'model_unavailable' WHEN n_raw IS NULL THEN 'unavailable' WHEN hours < 0 THEN 'model_error' WHEN (d - us) / 3.6e9 > 72 THEN 'stale' WHEN all_low THEN 'low_confidence' WHEN n_raw <= 1 THEN 'cold_start' ELSE 'available' END AS status FROM sc),
fn AS (SELECT *, status IN ('stale', 'low_confidence', 'cold_start', 'available') AS kept, status NOT IN ('model_unavailable', 'unavailable') AS seen, greatest(0, fill_rate_1h) AS grow FROM sx)
SELECT d AS decision_us, CASE WHEN seen THEN us END AS us, '2.0' AS schema_version, bin_id, status, CASE WHEN status = 'model_unavailable' THEN 'decision before {DECISIONS[2]}' WHEN status = 'stale' THEN 'latest reading is ' || format('{{:.1f}}', (d - us) / 3.6e9) || ' h old (at most 72.0)' END AS reason,
 CASE WHEN kept THEN round(hours, 2) END AS time_to_service_threshold_hours, CASE WHEN kept THEN {_risk('hours')} END AS risk_level, CASE WHEN kept OR status = 'model_error' THEN round(fill_pct, 1) END AS fill_pct, CASE WHEN seen THEN confidence_flag ELSE 0 END AS confidence_flag,
 90.0 AS target_threshold_pct, 'expected_hours_to_service_threshold' AS estimate_type, 'six-hour' AS model_version, repeat('0', 64) AS model_sha256, CASE WHEN seen THEN waste_type END AS waste_type, false AS waste_type_used_as_feature, 'grid-1' AS input_snapshot_id,
 CASE WHEN kept THEN array_to_string([h || ':' || format('{{:.1f}}', round(least(100, fill_pct + grow * h), 1)) || ':' || format('{{:.1f}}', round(grow * h, 1)) || ':unsupported' FOR h IN [6, 24, 48, 168]], ',') END AS horizons FROM fn""",
    "grid_statuses": f"""WITH {GRID}, few AS (SELECT * FROM grid WHERE d IN ({', '.join(f"epoch_us(TIMESTAMP '{t}')" for t in SQL_TIMES[::7])})),
p AS (SELECT *, n_raw IS NULL AS none, CASE WHEN (d - us) / 3.6e9 > 72 THEN 'stale' WHEN all_low THEN 'low_confidence' WHEN n_raw <= 1 THEN 'cold_start' ELSE 'available' END AS good FROM few),
c AS (SELECT 'plain' AS case_name, d, bin_id, CASE WHEN none THEN 'unavailable' ELSE good END AS status, NOT none AS h, NOT none AS f FROM p UNION ALL SELECT 'threshold', d, bin_id, CASE WHEN none THEN 'unavailable' ELSE 'unsupported_threshold' END, false, NOT none FROM p
 UNION ALL SELECT 'columns', d, bin_id, CASE WHEN none THEN 'unavailable' ELSE 'missing_required_columns' END, false, false FROM p UNION ALL SELECT 'scorer', d, bin_id, CASE WHEN none THEN 'unavailable' ELSE 'model_error' END, false, NOT none FROM p
 UNION ALL SELECT 'early', d, bin_id, CASE WHEN d < epoch_us(TIMESTAMP '{SQL_TIMES[14]}') THEN 'model_unavailable' WHEN none THEN 'unavailable' ELSE good END, NOT none AND d >= epoch_us(TIMESTAMP '{SQL_TIMES[14]}'), NOT none AND d >= epoch_us(TIMESTAMP '{SQL_TIMES[14]}') FROM p WHERE bin_id <> 'BIN-NONE'
 UNION ALL SELECT 'no_bins', NULL, NULL, 'invalid_input', false, false)
SELECT case_name, d AS decision_us, status, count(*) AS n, count(bin_id) AS n_bins, count(*) FILTER (WHERE h) AS n_hours, count(*) FILTER (WHERE f) AS n_fill FROM c GROUP BY ALL""",
    "kpi_overflow": f"WITH {READINGS_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT bin_id) FILTER (WHERE fill_pct >= 90) AS overflowed, count(DISTINCT bin_id) AS bins FROM readings GROUP BY CAST(ts AS DATE)",
    "unnecessary_trips": f"WITH {READINGS_SQL}, {STOPS_SQL}, x AS (SELECT s.route, s.stop_id, r.fill_pct FROM stops s ASOF LEFT JOIN readings r ON s.bin_id = r.bin_id AND s.us >= r.us) SELECT route, count(*) AS stops, count(*) FILTER (WHERE fill_pct < 60) AS unnecessary, count(*) FILTER (WHERE fill_pct IS NULL) AS unknown FROM x GROUP BY route",
    "colour_band": f"WITH {READINGS_SQL} SELECT seq, CASE WHEN fill_pct > 85 THEN 'red' WHEN fill_pct >= 60 THEN 'amber' ELSE 'green' END AS colour FROM readings",
    "sensor_alerts": f"""WITH {READINGS_SQL}, a AS (SELECT *, lag(fill_pct) OVER w AS b, lead(us) OVER w AS nx FROM readings WINDOW w AS (PARTITION BY bin_id ORDER BY us, seq)),
g AS (SELECT *, sum(CASE WHEN fill_pct >= 90 THEN 0 ELSE 1 END) OVER (PARTITION BY bin_id ORDER BY us, seq) AS grp, sum(CASE WHEN b = fill_pct THEN 0 ELSE 1 END) OVER (PARTITION BY bin_id ORDER BY us, seq) AS flat FROM a),
k AS (SELECT *, min(us) FILTER (WHERE fill_pct >= 90) OVER (PARTITION BY bin_id, grp) AS since, row_number() OVER (PARTITION BY bin_id, flat ORDER BY us, seq) AS n FROM g),
u AS (SELECT bin_id, 'jump' AS alert FROM k WHERE fill_pct - b > 50 UNION ALL SELECT bin_id, 'above_100' FROM k WHERE fill_pct > 100 UNION ALL SELECT bin_id, 'below_0' FROM k WHERE fill_pct < 0 UNION ALL SELECT bin_id, 'flat_line' FROM k WHERE n = 6 UNION ALL SELECT bin_id, 'not_collected' FROM k WHERE fill_pct >= 90 AND us - since > 24 * 3600000000)
SELECT bin_id, alert, count(*) AS n FROM u GROUP BY ALL""",
    "fill_at_pickup": f"WITH {READINGS_SQL}, a AS (SELECT bin_id, fill_pct, lag(fill_pct) OVER (PARTITION BY bin_id ORDER BY us) AS b FROM readings) SELECT bin_id, count(*) AS pickups, round(avg(b), 6) AS mean_fill FROM a WHERE fill_pct - b < -35 GROUP BY bin_id",
    "priority_rank": f"WITH {FEATURES}, l AS (SELECT bin_id, waste_type AS area, fill_pct / 100 * 0.6 + abs(fill_rate_1h) / 50 * 0.3 + confidence_flag * 0.1 AS score FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1) SELECT bin_id, area, round(score, 6) AS score, rank() OVER (PARTITION BY area ORDER BY round(score, 9) DESC, bin_id) AS place FROM l",
}
ORACLES |= {"stage_table": ORACLES["label_cycles"], "feature_table_chunked": ORACLES["feature_table"]}
