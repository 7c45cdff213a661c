"""The operators on streams: aggregates by bin and event time, keyed state, and sinks that a replayed batch can't spoil."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fillwatch.operators.features import BANDS, BARRIER, HOUR, RATE_LIMIT, RESET, SECOND, add_rate_features
from fillwatch.operators.labels import naive_forecast, risk_level
from fillwatch.operators.records import price_items
from fillwatch.operators.snapshot import MAX_STALENESS, resolve_bins
from fillwatch.session import delete, exists

#: What a bin's state remembers of its segment for the rates.
LOOKBACK_US = max(high for _, _, high in BANDS.values()) * SECOND
_READING = "bin_id string, us long, fill_pct double, cycle_id long, time_since_reset_hours double, fill_rate_1h double, fill_rate_6h double"
READING = Row(*(c.split()[0] for c in _READING.split(", ")))


def rates(recent: list[tuple[int, float]], t: int, fill: float) -> tuple[float, float]:
    """The 1 h and 6 h rates of a reading, from the earlier ones of its segment (newest last; see add_rate_features)."""

    def nearest(low: int, target: int, high: int) -> float | None:
        near = min(((abs(t - u - target * SECOND), t - u, f) for u, f in recent if low * SECOND <= t - u <= high * SECOND), default=None)
        return None if near is None else ((fill - near[2]) / (near[1] / HOUR) if near[1] / HOUR > 0.01 else 0.0)

    one, six = nearest(*BANDS[1]), nearest(*BANDS[2])
    if one is None:
        u, f = recent[-1] if recent else (t, fill)
        one = (fill - f) / ((t - u) / HOUR) if 60 * SECOND <= t - u <= 86400 * SECOND else 0.0
    clip = lambda x: max(-RATE_LIMIT, min(RATE_LIMIT, x))
    return clip(one), clip(one if six is None else six)


def on_disk(spark: SparkSession) -> None:
    """State in RocksDB: what a stream remembers need not fit the executors' memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _last_readings(log: DataFrame, late: str) -> DataFrame:
    """(bin_id, ts, us, r): the last reading by seq of each bin and time as a struct, once the watermark has passed the time.

    A streaming aggregate by bin and event time: its state is one row for each of them, and it hands on all that a new
    watermark has passed, in one batch. So whatever follows may go on from bin to bin in the order of time. Readings
    without a time are left out, late ones dropped (see late_rows).
    """
    on_disk(log.sparkSession)
    seq = F.col("seq").cast("long") if "seq" in log.columns else F.lit(None).cast("long")
    rest = [c for c in log.columns if c not in ("bin_id", "ts", "seq")]
    x = log.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col("bin_id").cast("string").alias("bin_id"), "ts", seq.alias("seq"), *rest)
    last = x.groupBy("bin_id", "ts").agg(F.max_by(F.struct("seq", *rest), F.struct("seq")).alias("r"))  # a struct: null seqs come first
    return last.select("bin_id", "ts", F.unix_micros("ts").alias("us"), "r")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, as far as the query's progress reports go back; in a batch, rows of one bin and time count as one."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A supplied Parquet table as a file stream of the batch table's schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def dedup_stream(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """One reading per bin and time, the last by seq as in batch, once the watermark has passed the time.

    (bin_id, us, seq, ..): all columns of the log, with the time in microseconds. Equal to dedup_last on the rows that
    aren't late.
    """
    return _last_readings(log, late).select("bin_id", "us", "r.*")


def session_totals_stream(items: DataFrame) -> DataFrame:
    """Running cents and counts per session (update or complete mode)."""
    on_disk(items.sparkSession)
    return price_items(items).groupBy("session_id").agg(F.sum("value_cents").alias("total_cents"), F.count_if(F.col("result") == "accepted").alias("accepted"), F.count(F.lit(1)).alias("n_events"))


class Rates(StatefulProcessor):
    """Cycles and rates of a bin's readings, which come once and in the order of time from batch to batch.

    State: the last reading, reset, cycle and the segment's last nine hours as one value, read and written once a bin and
    batch: every call of the state is a round trip from Python, whatever it moves.
    """

    def __init__(self, drop_pct: float, barrier: float):
        self.drop_pct, self.barrier = drop_pct, barrier

    def init(self, handle: Any) -> None:
        self.bin = handle.getValueState("bin", "last long, fill double, reset long, cycle long, us array<long>, fills array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, before, reset, cycle, times, fills = self.bin.get() or (None, None, None, 0, [], [])
        segment = list(zip(times, fills, strict=True))
        for t, fill in sorted((r.us, r.fill_pct) for r in rows):
            step = None if last is None else fill - before
            if step is not None and step < -self.drop_pct:
                cycle, reset = cycle + 1, t
            if step is not None and step < -self.barrier:
                segment = []
            elif last is not None and not segment:
                segment = [(last, before)]
            reset = t if reset is None else reset
            yield READING(key[0], t, fill, cycle, (t - reset) / HOUR, *rates(segment, t, fill))
            segment, last, before = [*(r for r in segment if t - r[0] <= LOOKBACK_US), (t, fill)], t, fill
        self.bin.update((last, before, reset, cycle, [t for t, _ in segment], [f for _, f in segment]))

    def close(self) -> None:
        pass


def level_stream(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """(bin_id, us, fill_pct): one level per bin and time, the last by seq, once the watermark has passed the time. Readings without a level or time are left out."""
    known = log.where("fill_pct IS NOT NULL")
    x = _last_readings(known.select([c for c in known.columns if c in ("bin_id", "ts", "seq", "fill_pct")]), late)
    return x.select("bin_id", "us", "r.fill_pct")


def reset_stream(log: DataFrame, late: str = "2 hours", drop_pct: float = RESET, barrier: float = BARRIER) -> DataFrame:
    """Each reading with its cycle, hours since the last reset and both rates, once the watermark has passed it.

    Equal to the batch operators over the rows that aren't late: rows within the watermark may come in any order and more
    than once (the last by seq counts). A quiet bin's rows come with the watermark too. Readings without a level or time
    are left out. Every bin of a batch costs calls between Python and the state; rates_upsert gives the same rows without
    them, where a sink for batches will do.
    """
    return level_stream(log, late).groupBy("bin_id").transformWithState(Rates(drop_pct, barrier), _READING, "Append", "None")


def staleness_stream(log: DataFrame, late: str = "2 hours", max_hours: float = 72.0) -> DataFrame:
    """(bin_id, last_us): an alert for each silence of more than max_hours of event time, as soon as the watermark proves it.

    A silence is what ends a session whose readings are max_hours apart at most. A session waits for the watermark, so a
    reading that comes late, but not too late, breaks a silence as it should. Readings without a time are left out.
    """
    on_disk(log.sparkSession)
    x = log.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col("bin_id").cast("string").alias("bin_id"), "ts")
    return x.groupBy("bin_id", F.session_window("ts", f"{int(max_hours * HOUR)} microseconds")).agg(F.unix_micros(F.max("ts")).alias("last_us")).select("bin_id", "last_us")


#: Parts that a stream's tables are laid out in, by a hash of the bin.
BUCKETS = 64
_RECENT = "bin_id string, us long, fill_pct double, cycle_id long, reset_us long, epoch long, bucket int"


def rates_upsert(path: str, then: Callable[[DataFrame, int], None], drop_pct: float = RESET, barrier: float = BARRIER, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over level_stream: reset_stream's rows of a batch, handed to then(rows, epoch), which must be done with them when it returns.

    The batch operators' windows run over the batch and what its bins remember, in one exchange by bin. A bin remembers its
    last nine hours of readings, at least the last one, each with its cycle and reset. They are laid out by epoch and
    bucket of bins; a batch reads and writes only the buckets that it touches. Each bucket keeps the version before its
    newest, so a batch that is run again starts from what it started from before.
    """
    path = path.rstrip("/")

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("bin_id", "us", "fill_pct", F.pmod(F.xxhash64("bin_id"), F.lit(buckets)).cast("int").alias("bucket"))
        rows.write.mode("overwrite").parquet(f"{path}-batch")  # a stateful batch is computed once, whatever is asked of it
        rows = spark.read.schema(rows.schema).parquet(f"{path}-batch")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        rows, versions = rows.select("*", F.lit(None).cast("long").alias("cycle_id"), F.lit(None).cast("long").alias("reset_us"), F.lit(True).alias("new")), {}
        if exists(spark, path):
            there = spark.read.schema(_RECENT).parquet(path).where(F.col("bucket").isin(touched) & (F.col("epoch") < epoch))
            for r in there.groupBy("bucket").agg(F.collect_set("epoch").alias("epochs")).collect():  # two a bucket
                versions[r.bucket] = sorted(r.epochs)
            newest = {e: [b for b, es in versions.items() if es[-1] == e] for e in {es[-1] for es in versions.values()}}
            if newest:
                there = there.where(reduce(lambda a, b: a | b, [(F.col("epoch") == e) & F.col("bucket").isin(bs) for e, bs in newest.items()]))
                rows = rows.unionByName(there.drop("epoch").withColumn("new", F.lit(False)))
        x = add_rate_features(rows.withColumnRenamed("us", "_us"), barrier, deduped=True)
        w = Window.partitionBy("bin_id").orderBy("_us")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("_drop", F.col("new") & F.coalesce(F.col("fill_pct") - F.lag("fill_pct").over(w) < -drop_pct, F.lit(False)))
        reset = F.last(F.when(F.col("_drop"), F.col("_us")).otherwise(F.col("reset_us")), ignorenulls=True).over(run)
        x = x.withColumns({
            "cycle_id": F.coalesce(F.max("cycle_id").over(run), F.lit(0)) + F.sum(F.col("_drop").cast("long")).over(run),
            "reset_us": F.coalesce(reset, F.first("_us").over(run)),
            "recent": F.col("_us") >= F.max("_us").over(Window.partitionBy("bin_id")) - LOOKBACK_US,
        }).withColumnRenamed("_us", "us").withColumn("time_since_reset_hours", (F.col("us") - F.col("reset_us")) / HOUR).drop("_drop")
        x.write.mode("overwrite").parquet(f"{path}-rates")
        x = spark.read.schema(x.schema).parquet(f"{path}-rates")
        x.where("recent").select("bin_id", "us", "fill_pct", "cycle_id", "reset_us", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
        then(x.where("new").select(*READING), epoch)
        for b, epochs in versions.items():
            for e in epochs[:-1]:
                delete(spark, f"{path}/epoch={e}/bucket={b}")

    return put


_SNAPSHOT = "bin_id string, us long, fill_pct double, fill_rate_1h double, n long, epoch long, bucket int"


def snapshot_upsert(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over reset_stream, or behind rates_upsert: the newest reading and the number of readings of every bin seen so far.

    The table is laid out by buckets of bins. A batch reads and overwrites only the buckets that it touches, so what is
    written grows with the batch, not with the table. Each bucket knows the last epoch that it took in and ignores that
    epoch and earlier ones, so a batch that is run again, whole or after part of its buckets, changes nothing.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark, keep = batch.sparkSession, ["bin_id", "us", "fill_pct", "fill_rate_1h", "n"]
        newest = F.max_by(F.struct("us", "fill_pct", "fill_rate_1h"), "us").alias("r")
        rows = batch.groupBy("bin_id").agg(newest, F.count(F.lit(1)).alias("n")).select("bin_id", "r.*", "n")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("bin_id"), F.lit(buckets)).cast("int"))
        taken = f"{path.rstrip('/')}-batch"
        rows.write.mode("overwrite").parquet(taken)  # a stateful batch is computed once, whatever is asked of it
        rows = spark.read.schema(rows.schema).parquet(taken).select(*keep, "bucket")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        if exists(spark, path):
            there = spark.read.schema(_SNAPSHOT).parquet(path).where(F.col("bucket").isin(touched))
            done = [r.bucket for r in there.groupBy("bucket").agg(F.max("epoch").alias("e")).where(F.col("e") >= epoch).collect()]
            touched = sorted(set(touched) - set(done))
            rows = rows.where(F.col("bucket").isin(touched)).unionByName(there.where(F.col("bucket").isin(touched)).select(*keep, "bucket"))
        if not touched:
            return
        latest = rows.groupBy("bucket", "bin_id").agg(newest, F.sum("n").alias("n"))
        out = latest.select("bin_id", "r.*", "n", F.lit(epoch).cast("long").alias("epoch"), "bucket")
        new = f"{path.rstrip('/')}-epoch"
        out.write.mode("overwrite").parquet(new)  # whole before it replaces what it was made of
        spark.read.schema(out.schema).parquet(new).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return put


def stream_snapshot(spark: SparkSession, path: str, decision_at: str, bins: DataFrame | list[str] | None = None, max_staleness_hours: float = MAX_STALENESS, fallback_hours: float = 168.0) -> DataFrame:
    """The forecast of every configured bin (None: every bin seen) from snapshot_upsert's table, with snapshot()'s statuses that
    it can tell: unavailable, stale, cold_start, available. A bin whose newest reading is later than decision_at is
    unavailable, as what came before isn't kept.
    """
    seen = spark.read.schema(_SNAPSHOT).parquet(path).where(F.col("us") <= F.unix_micros(F.lit(decision_at).cast("timestamp")))
    known = naive_forecast(seen.drop("bucket"), fallback_hours)
    out = known if bins is None else resolve_bins(bins, seen).hint("merge").join(known, "bin_id", "left")
    age = (F.unix_micros(F.lit(decision_at).cast("timestamp")) - F.col("us")) / HOUR
    status = F.when(F.col("n").isNull(), "unavailable").when(age > max_staleness_hours, "stale").when(F.col("n") <= 1, "cold_start").otherwise("available")
    return out.select("bin_id", "us", "n", status.alias("status"), F.round("fill_pct", 1).alias("fill_pct"), F.when(F.col("n").isNotNull(), F.round("naive_hours", 2)).alias("hours"), F.when(F.col("n").isNotNull(), risk_level(F.col("naive_hours"))).alias("risk_level"), "epoch")


def epochs_upsert(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, or behind rates_upsert: each epoch's rows as a part of their own; an epoch run again overwrites its part."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return put


def totals_upsert(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over session_totals_stream in update mode: each epoch's changed sessions."""
    return epochs_upsert(path)


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every session that totals_upsert has written."""
    x = spark.read.parquet(path)
    cols = [c for c in x.columns if c not in ("session_id", "epoch")]
    return x.groupBy("session_id").agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select("session_id", "r.*")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", put: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Takes in all that there is and stops: into Parquet files at path, or batch by batch into put. What was taken in before is known from the checkpoint."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.format("parquet").option("path", path) if put is None else w.foreachBatch(put)).start()
    q.awaitTermination()
    return q
