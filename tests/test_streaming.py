"""Streams give what the batch operators give on the same rows."""

import glob

import pytest
from pyspark.sql import functions as F

from fillwatch.operators import features as X
from fillwatch.operators.labels import naive_forecast
from fillwatch.plans import streams as P
from fillwatch.streaming import streams as T

SF = "/root/testdata/sf0.001"
SCHEMA = "bin_id string, ts timestamp, fill_pct double, seq long"


@pytest.fixture
def parts(spark, tmp_path):
    """A log in three files, out of order within two hours, and a last reading that moves the watermark on."""
    rows = [("a" if i % 3 else "b", f"2026-01-01 {i // 2:02d}:{i % 2 * 30:02d}:00", float(i * 17 % 100), i) for i in range(40)]
    rows[5], rows[6] = rows[6], rows[5]
    df = spark.createDataFrame(rows, "bin_id string, ts string, fill_pct double, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        df.where((F.col("seq") >= k * 14) & (F.col("seq") < (k + 1) * 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    end = spark.createDataFrame([("z", "2026-02-01 00:00:00", 1.0, 1000)], "bin_id string, ts string, fill_pct double, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return df, str(tmp_path / "log")


def drain(spark, df, where, mode="append"):
    path = f"{where}/out"
    T.run_available(df, path, f"{where}/cp", mode)
    return spark.read.parquet(path)


def stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_resets(spark, parts, tmp_path):
    batch, path = parts
    got = drain(spark, T.reset_stream(stream(spark, path), "12 hours"), tmp_path).where("bin_id <> 'z'")
    want = X.add_reset_features(X.add_rate_features(batch)).select("bin_id", X.us().alias("us"), "fill_pct", "cycle_id", "time_since_reset_hours", "fill_rate_1h", "fill_rate_6h")
    assert rounded(got) == rounded(want) and got.count() == 40


def test_dedup_keeps_the_last(spark, tmp_path):
    """Repeats in one file and over files, in any order; late rows are dropped and counted; null times are left out."""
    log, out = str(tmp_path / "log"), str(tmp_path)
    day = lambda rows: spark.createDataFrame(rows, "bin_id string, ts string, fill_pct double, seq long, note string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(log)
    schema = "bin_id string, ts timestamp, fill_pct double, seq long, note string"
    day([("a", "2026-01-01 00:00:00", 1.0, 5, "x"), ("a", "2026-01-01 00:00:00", 2.0, 9, "last"), ("a", None, 3.0, 1, "none"), ("b", "2026-01-01 00:30:00", None, None, None)])
    T.run_available(T.dedup_stream(stream(spark, log, schema)), f"{out}/out", f"{out}/cp")
    day([("a", "2026-01-01 00:00:00", 3.0, 7, "y"), ("a", "2026-01-01 01:00:00", 4.0, 1, "z")])
    day([("z", "2026-01-03 00:00:00", 0.0, 1, "end")])
    T.run_available(T.dedup_stream(stream(spark, log, schema)), f"{out}/out", f"{out}/cp")
    day([("a", "2026-01-01 00:00:00", 5.0, 99, "too late"), ("z", "2026-01-05 00:00:00", 0.0, 1, "end")])
    q = T.run_available(T.dedup_stream(stream(spark, log, schema)), f"{out}/out", f"{out}/cp")
    got = sorted((r.bin_id, r.fill_pct, r.seq, r.note) for r in spark.read.parquet(f"{out}/out").where("note <> 'end' OR note IS NULL").collect())
    assert got == [("a", 2.0, 9, "last"), ("a", 4.0, 1, "z"), ("b", None, None, None)] and T.late_rows(q) == 1


def test_silence(spark, tmp_path):
    """One alert for each silence; a reading that comes later but breaks a silence in time prevents the alert."""
    log = str(tmp_path / "log")
    day = lambda rows: spark.createDataFrame(rows, "bin_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(log)
    day([("a", "2026-01-01 00:00:00"), ("a", None), ("b", "2026-01-01 00:00:00"), ("b", "2026-01-05 00:00:00")])
    day([("c", "2026-01-01 12:00:00"), ("b", "2026-01-02 23:00:00"), ("a", "2026-01-04 00:00:00")])
    day([("a", "2026-01-20 00:00:00"), ("z", "2026-02-01 00:00:00")])
    got = drain(spark, T.staleness_stream(stream(spark, log, "bin_id string, ts timestamp"), "5 days"), tmp_path)
    stamp = lambda r: f"{r.bin_id} {r.last_us // 86_400_000_000 - 20_453:.0f}"
    assert sorted(map(stamp, got.collect())) == ["a 20", "a 4", "b 5", "c 1"]


def test_session_totals(spark, tmp_path):
    rows = [(i % 5, "Can", "accepted" if i % 3 else "rejected", None) for i in range(50)]
    df = spark.createDataFrame(rows, "session_id long, type string, result string, reason string")
    df.repartition(3).write.parquet(str(tmp_path / "items"))
    put = T.totals_upsert(str(tmp_path / "totals"))

    def twice(b, epoch):
        put(b, epoch)
        put(b, epoch)

    T.run_available(T.session_totals_stream(stream(spark, str(tmp_path / "items"), df.schema)), "", str(tmp_path / "cp"), "update", twice)
    got = {r.session_id: (r.total_cents, r.n_events) for r in T.latest_totals(spark, str(tmp_path / "totals")).collect()}
    assert got == {k: (20 * sum(1 for i in range(50) if i % 5 == k and i % 3), 10) for k in range(5)}


def test_snapshot_per_batch(spark, parts, tmp_path):
    batch, path = parts
    out, ends = str(tmp_path / "latest"), []
    put = T.snapshot_upsert(out, 8)

    def each(b, epoch):
        put(b, epoch)
        put(b, epoch)  # a batch that is run again changes nothing
        ends.append(epoch)

    T.run_available(T.reset_stream(stream(spark, path), "12 hours"), "", str(tmp_path / "cp"), put=each)
    got = {r.bin_id: r for r in T.stream_snapshot(spark, out, "2026-01-02T00:00:00Z", ["a", "b", "c"]).collect()}
    want = {r.bin_id: r for r in naive_forecast(X.latest_per_bin(X.add_rate_features(batch)), 168.0).collect()}
    n = {r.bin_id: r["count"] for r in batch.groupBy("bin_id").count().collect()}
    assert len(ends) > 2 and (got["c"].status, got["c"].hours) == ("unavailable", None)
    assert {k: (r.n, r.status, r.hours) for k, r in got.items() if k != "c"} == {k: (n[k], "available", round(r.naive_hours, 2)) for k, r in want.items()}
    assert {r.status for r in T.stream_snapshot(spark, out, "2026-01-30T00:00:00Z").collect()} == {"stale"}


def test_only_touched_buckets_are_written(spark, tmp_path):
    """A batch's bytes grow with the batch; an epoch that was cut off is finished, and no bin counts twice."""
    out, schema = str(tmp_path / "s"), "bin_id string, us long, fill_pct double, fill_rate_1h double"
    put, files = T.snapshot_upsert(out), lambda: set(glob.glob(f"{out}/bucket=*/*.parquet"))
    put(spark.createDataFrame([(f"b{i}", 5, 80.0, 10.0) for i in range(500)], schema), 7)
    before = files()
    one = spark.createDataFrame([("b3", 9, 85.0, 10.0), ("b3", 8, 84.0, 10.0)], schema)
    put(one, 8)
    assert len(before) > 50 and len(files() - before) == 1 and len(before - files()) == 1
    both = spark.createDataFrame([("b3", 9, 85.0, 10.0), ("b4", 9, 85.0, 10.0)], schema)
    put(both, 8)  # b3's bucket has this epoch already, b4's hasn't
    put(both, 8)
    got = {r.bin_id: r for r in T.stream_snapshot(spark, out, "1970-01-01T00:00:01Z").collect()}
    assert len(got) == 500 and (got["b3"].n, got["b3"].us, got["b3"].epoch) == (3, 9, 8) and (got["b4"].n, got["b4"].epoch) == (2, 8)
    assert (got["b5"].n, got["b5"].status, got["b5"].hours, got["b5"].epoch) == (1, "cold_start", 1.0, 7)


def test_feed_is_written_by_all_tasks_and_taken_as_one_batch(spark, tmp_path):
    """However large a part is, no task has it whole; a run takes in its files together, so none is late."""
    log = spark.range(4000).repartition(4).select((F.col("id") % 7).cast("string").alias("bin_id"), F.timestamp_seconds(F.col("id") * 600 + 1_760_000_000).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 90).cast("double").alias("fill_pct"))
    at = str(tmp_path / "log")
    steps, files = P._feed(log, at), []
    for step in steps:
        step()
        files.append(len(glob.glob(f"{at}/*.parquet")))
        T.run_available(T.dedup_stream(spark.readStream.schema(log.schema).parquet(at), "12 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert files[0] > 1 and files[1] > files[0] + 1 and files[2] > files[1] + 1
    assert spark.read.parquet(str(tmp_path / "out")).where("bin_id <> 'END'").count() == 4000


def test_repeats_are_told_without_python(spark):
    """A reading costs no call of a Python worker, neither for dedup nor for silences."""
    log = spark.readStream.format("rate").load().select(F.lit("a").alias("bin_id"), F.col("timestamp").alias("ts"), F.col("value").alias("seq"), F.lit(1.0).alias("fill_pct"))
    for out in (T.dedup_stream(log), T.staleness_stream(log)):
        assert "TransformWithState" not in out._jdf.queryExecution().analyzed().toString()


def test_totals_are_fed_by_all_tasks(spark, tmp_path, monkeypatch):
    """Four files of items: each is written on by its own task, to each of the three parts."""
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(P, "shared_dir", lambda spark: str(tmp_path / "shared"))
    assert P.stream_totals(spark, str(tmp_path)).count() > 0
    assert len(glob.glob(f"{tmp_path}/shared/totals-*/items/*.parquet")) == 12


def test_silence_at_its_border(spark, tmp_path):
    """Readings exactly max_hours apart are no silence, a microsecond more is one."""
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-02 00:00:00"), ("b", "2026-01-01 00:00:00"), ("b", "2026-01-02 00:00:00.000001"), ("z", "2026-02-01 00:00:00")]
    spark.createDataFrame(rows, "bin_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "log"))
    got = drain(spark, T.staleness_stream(stream(spark, str(tmp_path / "log"), "bin_id string, ts timestamp"), "12 hours", 24.0), tmp_path)
    assert sorted((r.bin_id, r.last_us - 1_767_225_600_000_000) for r in got.collect()) == [("a", 86_400_000_000), ("b", 0), ("b", 86_400_000_001)]


def test_rates_by_windows(spark, tmp_path):
    """Batch by batch, each run twice and one cut off before its rows were taken in: rows and cycles are those of the whole log."""
    rows = [(f"b{i % 7}", 600_000_000 * i + i % 3, float(i * i * 31 % 106)) for i in range(1500)] + [("once", 5, 50.0)]
    log = spark.createDataFrame(rows, "bin_id string, us long, fill_pct double").withColumn("ts", F.timestamp_micros("us")).withColumn("seq", F.col("us")).cache()
    at, out, cut = str(tmp_path / "recent"), str(tmp_path / "out"), {2}

    def then(x, epoch):
        if epoch in cut:
            cut.remove(epoch)
            raise ValueError("cut off")
        T.epochs_upsert(out)(x, epoch)

    put = T.rates_upsert(at, then, buckets=4)
    for epoch in range(6):
        part = log.where((F.col("us") >= epoch * 160_000_000_000) & (F.col("us") < (epoch + 1) * 160_000_000_000))
        if epoch == 2:
            with pytest.raises(ValueError, match="cut off"):
                put(part, epoch)
        put(part, epoch)
        put(part, epoch)
        put(part.where("false"), 100 + epoch)
    want = X.add_reset_features(X.add_rate_features(log)).select("bin_id", "us", "fill_pct", "cycle_id", "time_since_reset_hours", "fill_rate_1h", "fill_rate_6h")
    assert rounded(spark.read.parquet(out).drop("epoch")) == rounded(want)
    kept = [len(glob.glob(f"{at}/epoch=*/bucket={b}")) for b in range(4)]
    assert max(kept) == 2 and spark.read.parquet(at).where("bin_id = 'once'").select("us").distinct().count() == 1


@pytest.mark.parametrize("name", ["stream_rates", "stream_snapshot"])
def test_rates_of_a_feed_without_python(spark, name, monkeypatch):
    """A bin costs no call of a Python worker in any batch, so large batches cost what windows over them cost."""
    plans, run = [], T.run_available
    monkeypatch.setattr(T, "run_available", lambda df, *a, **k: plans.append(df._jdf.queryExecution().analyzed().toString()) or run(df, *a, **k))
    assert P.QUERIES[name](spark, SF).count() > 0
    assert len(plans) == 4 and not any("TransformWithState" in p for p in plans)
