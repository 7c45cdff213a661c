"""Registered queries over streams: the sensor log and the items as files that come in several parts, with a restart between them.

Every stream takes in a part, ends, and goes on from its checkpoint with the next. Its rows are compared with
what batch SQL makes of the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.operators import features as X
from fillwatch.plans.telemetry import DEDUP, FEATURES, R6, r6
from fillwatch.session import shared_dir, stored
from fillwatch.sources.adapters import ITEMS_SQL, READINGS_SQL, item_events, readings, readings_dup
from fillwatch.streaming import streams as T

#: Parts of a feed, how far readings may come out of order, and how long a stream waits for them.
PARTS, DISORDER_US, LATE = 3, 5 * 3600 * X.SECOND, "12 hours"
#: Ends the stream: this long after the newest reading, so that all timers go off.
END_DAYS = 40


def _feed(log: DataFrame, path: str) -> list[Callable[[], None]]:
    """Writes the log in parts, out of order by up to DISORDER_US over their borders; the last is a reading that ends the stream.

    The log is computed once; all tasks write a part's files, however large it is.
    """
    log = stored(log, "feed")
    spark = log.sparkSession
    low, high = log.agg(F.min(X.us()), F.max(X.us())).first()
    width = (high - low + DISORDER_US) // PARTS + 1
    part = F.floor((X.us() - low + F.col("seq") * 7919 % DISORDER_US) / width)

    def put(k: int) -> None:
        log.where(part == k).write.mode("append").parquet(path)

    def end() -> None:
        last = spark.range(1).select(F.lit("END").alias("bin_id"), F.timestamp_micros(F.lit(high + END_DAYS * 86_400 * X.SECOND)).alias("ts"))
        last.select(*[F.col(f.name) if f.name in ("bin_id", "ts") else F.lit(0).cast(f.dataType).alias(f.name) for f in log.schema]).coalesce(1).write.mode("append").parquet(path)

    return [*[lambda k=k: put(k) for k in range(PARTS)], end]


def _through(spark: SparkSession, log: DataFrame, make: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What a stream over the feed has written: a run for each part, which takes in all its files as one batch."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for step in _feed(log, f"{at}/log"):
        step()
        T.run_available(make(spark.readStream.schema(log.schema).parquet(f"{at}/log")), f"{at}/out", f"{at}/checkpoint", put=put)
    return None if put else spark.read.parquet(f"{at}/out").where("bin_id <> 'END'")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One reading per bin and time, the last by seq."""
    return _through(spark, readings_dup(spark, d), lambda s: T.dedup_stream(s, LATE)).select("bin_id", "us", "seq", F.round("fill_pct", 6).alias("fill_pct"), "confidence_flag", "waste_type")


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Cycles, hours since the last reset and both rates."""
    at = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
    _through(spark, readings_dup(spark, d), lambda s: T.level_stream(s, LATE), T.rates_upsert(f"{at}/recent", T.epochs_upsert(f"{at}/rates")))
    return spark.read.parquet(f"{at}/rates").where("bin_id <> 'END'").select("bin_id", "us", "cycle_id", *r6("time_since_reset_hours", "fill_rate_1h", "fill_rate_6h"))


def stream_silence(spark: SparkSession, d: str) -> DataFrame:
    """Bins silent for more than a day."""
    return _through(spark, readings(spark, d), lambda s: T.staleness_stream(s, LATE, 24.0))


def stream_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The forecast of every configured bin after the last batch."""
    at = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    _through(spark, readings_dup(spark, d), lambda s: T.level_stream(s, LATE), T.rates_upsert(f"{at}-recent", T.snapshot_upsert(at)))
    bins = readings(spark, d).select("bin_id").distinct().union(spark.range(1).select(F.lit("BIN-NONE")))
    return T.stream_snapshot(spark, at, "2024-02-01T00:00:00Z", bins).drop("epoch")


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cents and counts of every session, from changed sessions batch by batch."""
    at, items = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}", item_events(spark, d)
    for k in range(PARTS):  # written where they are read, by all tasks, and taken in as one batch
        items.where(F.pmod(F.xxhash64("session_id", "line"), F.lit(PARTS)) == k).write.mode("append").parquet(f"{at}/items")
        source = spark.readStream.schema(items.schema).parquet(f"{at}/items")
        T.run_available(T.session_totals_stream(source), "", f"{at}/checkpoint", "update", T.totals_upsert(f"{at}/totals"))
    return T.latest_totals(spark, f"{at}/totals").select("session_id", F.col("total_cents").cast("long").alias("total_cents"), "accepted", "n_events")


QUERIES = {"stream_dedup": stream_dedup, "stream_rates": stream_rates, "stream_silence": stream_silence, "stream_snapshot": stream_snapshot, "stream_totals": stream_totals}

_END = "TIMESTAMP '2024-02-01 00:00:00'"
ORACLES = {
    "stream_dedup": f"WITH {DEDUP} SELECT bin_id, us, seq, round(fill_pct, 6) AS fill_pct, confidence_flag, waste_type FROM dd",
    "stream_rates": f"WITH {FEATURES} SELECT bin_id, us, cycle_id, {R6('time_since_reset_hours', 'fill_rate_1h', 'fill_rate_6h')} FROM rs",
    "stream_silence": f"WITH {READINGS_SQL}, g AS (SELECT bin_id, us, lead(us) OVER (PARTITION BY bin_id ORDER BY us) AS nx FROM (SELECT DISTINCT bin_id, us FROM readings)) SELECT bin_id, us AS last_us FROM g WHERE coalesce(nx - us > 86400000000, true)",
    "stream_snapshot": f"""WITH {FEATURES}, n AS (SELECT bin_id, count(*) AS n FROM dd GROUP BY bin_id), l AS (SELECT bin_id, us, fill_pct, fill_rate_1h FROM rt QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1),
b AS (SELECT DISTINCT bin_id FROM readings UNION SELECT 'BIN-NONE'),
x AS (SELECT b.bin_id, us, n, fill_pct, CASE WHEN n IS NOT NULL THEN least(200, CASE WHEN fill_rate_1h = 0 THEN 168.0 ELSE greatest(90 - fill_pct, 0) / abs(fill_rate_1h) END) END AS hours FROM b LEFT JOIN l USING (bin_id) LEFT JOIN n USING (bin_id))
SELECT bin_id, us, n, CASE WHEN n IS NULL THEN 'unavailable' WHEN (epoch_us({_END}) - us) / 3.6e9 > 72 THEN 'stale' WHEN n <= 1 THEN 'cold_start' ELSE 'available' END AS status, round(fill_pct, 1) AS fill_pct, round(hours, 2) AS hours,
 CASE WHEN hours IS NULL THEN NULL WHEN hours < 4 THEN 'Critical' WHEN hours < 12 THEN 'High' WHEN hours < 24 THEN 'Medium' ELSE 'Low' END AS risk_level FROM x""",
    "stream_totals": f"WITH {ITEMS_SQL} SELECT session_id, CAST(20 * count(*) FILTER (WHERE result = 'accepted') AS BIGINT) AS total_cents, count(*) FILTER (WHERE result = 'accepted') AS accepted, count(*) AS n_events FROM item_events GROUP BY session_id",
}
