"""What keeps single keys and columns from landing in one task gives what the plain operators give."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from fillwatch.operators import features as X
from fillwatch.operators import labels as L
from fillwatch.operators import records as R
from fillwatch.operators.chunked import KEY, build_feature_table_chunked, chunk_rates
from fillwatch.operators.quantiles import exact_percentiles, order_statistics
from fillwatch.sources import readers as I

LOG = "bin_id string, us long, fill_pct double, seq long"


def long_log(spark, seed=1):
    """One bin with half of all readings, others sparse, with gaps of days, drops after gaps, nulls and repeats."""
    rng, rows = random.Random(seed), []
    for b in range(7):
        t = 1_760_000_000 + rng.randrange(86_400)
        for _ in range(1500 if b == 0 else rng.choice([1, 40, 250])):
            t += rng.choice([0, 300, 900, 1800, 3600, 5000, 20_000]) if b == 0 else rng.choice([1800, 7200, 86_400, 86_401, 400_000])
            rows.append((f"b{b}", t * 1_000_000 + rng.randrange(3), rng.choice([None, *[float(rng.randrange(101))] * 20]), len(rows)))
    return spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(4)


def rounded(df, cols):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("days", [1, 3])
def test_chunked_features(spark, days):
    log = long_log(spark)
    cols = ["bin_id", "ts", "seq", "cycle_id", *X.FEATURES]
    assert rounded(build_feature_table_chunked(log, days), cols) == rounded(X.build_feature_table(log), cols)
    kept = build_feature_table_chunked(log.withColumn("cycle_id", F.lit(7)), days)
    assert {r.cycle_id for r in kept.select("cycle_id").distinct().collect()} == {7} and build_feature_table_chunked(log.where("false")).count() == 0


def test_no_window_is_longer_than_a_chunk(spark):
    """Half of the rows are one bin's; windows over readings are keyed by chunk, which holds a day and the day before it."""
    log = long_log(spark)
    plan = chunk_rates(log, 1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin_id#" in plan and plan.count("Exchange hashpartitioning") == 1 and all(k in plan.split("Exchange hashpartitioning(")[1].split(")")[0] for k in KEY)
    sizes = [r["count"] for r in chunk_rates(log, 1).groupBy(*KEY).count().collect()]
    assert sum(sizes) == X.dedup_last(log).count() and max(sizes) < 1500 / 20


def test_stage_table_needs_no_exchange(spark, tmp_path):
    log = X.build_feature_table(long_log(spark))
    table = I.write_stage_table(log, f"t{uuid.uuid4().hex}", str(tmp_path / "t"), 4)
    plan = L.build_labels(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    cols = ["bin_id", "ts", "time_to_overflow_hours", "risk_level"]
    assert rounded(L.build_labels(table), cols) == rounded(L.build_labels(log), cols)
    part = spark.read.parquet(str(tmp_path / "t")).select("bin_id", "ts", F.col("_metadata.file_path").alias("f"))
    assert part.select("f", "bin_id").distinct().groupBy("bin_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 3000, list(range(5000)), [random.Random(3).gauss(0, 1) for _ in range(20_000)], [0.0] * 9000 + list(range(2000)), [float("inf"), -1.0, None, 3.0]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.731, 0.999, 1.0]
    want = df.agg(*[F.percentile("x", s).alias(f"p{k}") for k, s in enumerate(shares)]).first()
    got = exact_percentiles(df, "x", shares, few=40)
    assert [None if g != g else g for g in got] == pytest.approx([None if w != w else w for w in want])
    assert exact_percentiles(df.where("false"), "x", [0.5]) == [None]


def test_order_statistics_narrow(spark):
    """Many values and a small limit: several rounds of brackets."""
    df = spark.range(300_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    every = sorted(r.x for r in df.collect())
    assert order_statistics(df, "x", [0, 17, 150_000, 299_999], few=4) == {k: every[k] for k in (0, 17, 150_000, 299_999)}


def plain_rule(text, rules):
    t = None if text is None else text.strip(" ").lower()
    hits = [(o, i) for o, i, ks in rules for k in ks if t is not None and len(t) >= 2 and k and k in t]
    return min(hits)[1] if hits else None


def test_rules_of_any_number(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rules = [(rng.randrange(500), f"r{k}", [word(rng.choice([1, 2, 3, 4, 5, 6, 9])) for _ in range(rng.randrange(1, 4))] if k > 3 else [["zz"], ["q"], ["", "é日本"], ["é日本語x"]][k]) for k in range(800)]
    rules = [r for r in rules if not any(len(k) == 1 and k in "abc" for k in r[2])]
    texts = [None, "", "a", "  A ", "zz", "x q y", "É日本", "plus é日本語x!", *[word(rng.randrange(12)) for _ in range(200)], *["XYZ " + word(6).upper()] * 3]
    df = spark.createDataFrame([(k // 2 if k < 20 else k, t) for k, t in enumerate(texts)], "key long, text string").repartition(3)
    table = spark.createDataFrame(rules, "rule_order int, rule_id string, keywords array<string>")
    got = sorted(((r.key, r.rule) for r in R.rules_join(df, "key", "text", table).collect()), key=repr)
    assert got == sorted(((k // 2 if k < 20 else k, plain_rule(t, rules)) for k, t in enumerate(texts)), key=repr)
    assert {r.rule for r in R.rules_join(df, "key", "text", table.where("false")).collect()} == {None}
    assert R.rules_join(df.where("false"), "key", "text", table).collect() == []


def test_a_hundred_thousand_keywords(spark):
    words = spark.range(100_000).select((-F.col("id")).alias("rule_order"), F.concat(F.lit("r"), "id").alias("rule_id"), F.array(F.sha2(F.col("id").cast("string"), 256).substr(1, 8)).alias("keywords"))
    texts = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("No "), F.sha2((F.col("id") * 401).cast("string"), 256).substr(1, 8))).otherwise("nothing here").alias("text"))
    got = {r.id: r.rule for r in R.rules_join(texts, "id", "text", words).collect()}
    assert got == {k: f"r{k * 401}" if k % 2 == 0 else None for k in range(200)}


def test_keywords_that_share_a_part_cost_no_pairs(spark):
    """5,000 keywords, all with one rare beginning, and 300 texts that have it: no text meets them all."""
    words = spark.range(5000).select(F.format_string("qzx%05d", "id").alias("k"))
    pieces = spark.range(300).select("id", F.format_string("a qzx%05d b", F.col("id") * 7).alias("p"))
    got = R._substrings(pieces, words, [8])
    assert got.count() == 300 and got.join(words, "k").count() == 300
    rules = words.select(F.lit(1).alias("rule_order"), F.col("k").alias("rule_id"), F.array("k").alias("keywords"))
    assert {r.id: r.rule for r in R.rules_join(pieces, "id", "p", rules).collect()} == {i: f"qzx{i * 7:05d}" for i in range(300)}


def test_partitions_of_the_event_log_follow_its_rows(spark):
    """The session's number of partitions is 4; more rows get more of them, in the one exchange that the window needs."""
    items = spark.range(6000).select((F.col("id") % 900).alias("session_id"), F.lit(1).alias("created_us"), F.col("id").alias("line"), F.col("id").alias("item_id"), F.lit("Can").alias("type"), F.lit("accepted").alias("result"))
    log = R.event_log(items, 500)
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert log.rdd.getNumPartitions() == 12 and plan.count("Exchange hashpartitioning") == 1
    key = ["session_id", "line", "number"]
    assert rounded(log, key) == rounded(R.event_log(items), key)
