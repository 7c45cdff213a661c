"""Literal cases of the features, labels, splits and snapshots, and their boundaries."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fillwatch.operators import features as X
from fillwatch.operators import labels as L
from fillwatch.operators import snapshot as S

COLS = "bin_id string, ts string, fill_pct double, confidence_flag int, seq long"


def log(spark, rows, **extra):
    """rows: (time, fill) of bin_01 with flag 1, or (bin, time, fill, flag)."""
    full = [(*(r if len(r) == 4 else ("bin_01", r[0], r[1], 1)), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(b, t, None if f is None else float(f), c, i) for b, t, f, c, i in full], COLS).withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withColumns(extra)


def at(seconds, fill):
    h, r = divmod(seconds, 3600)
    return f"2026-01-{1 + h // 24:02d} {h % 24:02d}:{r // 60:02d}:{r % 60:02d}", fill


def rates(spark, rows):
    out = X.add_rate_features(log(spark, rows)).orderBy("ts").collect()
    return [(round(r.fill_rate_1h, 6), round(r.fill_rate_6h, 6)) for r in out]


def test_single_reading(spark):
    assert rates(spark, [at(0, 45)]) == [(0.0, 0.0)]


def test_repeated_time_keeps_the_last(spark):
    x = X.dedup_last(log(spark, [at(36000, 20), at(36000, 22), at(39600, 30)])).orderBy("ts").collect()
    assert [r.fill_pct for r in x] == [22, 30]
    assert rates(spark, [at(36000, 20), at(36000, 22), at(39600, 30)])[-1][0] == 8.0


def test_fallback_over_a_gap(spark):
    assert abs(rates(spark, [at(0, 0), at(1800, 5), at(3600, 10), at(18000, 50)])[-1][0] - 10) <= 1


def test_ten_features_without_nulls(spark):
    f = X.build_feature_table(log(spark, [at(36000, 20), at(39600, 25), at(43200, 30)])).collect()
    assert len(f) == 3 and all(r[c] is not None for r in f for c in X.FEATURES)


def test_equal_distance_takes_the_later(spark):
    assert rates(spark, [at(0, 0), at(600, 50), at(3900, 60)])[-1][0] == round(10 / (3300 / 3600), 6)


@pytest.mark.parametrize(("age", "used"), [(900, True), (7200, True), (899, True), (7201, True), (59, False), (60, True), (86400, True), (86401, False)])
def test_band_edges_of_one_hour(spark, age, used):
    # outside the band the reading just before still counts, between a minute and a day
    r = rates(spark, [at(0, 0), at(age, 1)])[-1][0]
    assert (r != 0) == used and (not used or abs(r - min(50, 3600 / age)) < 1e-6)


@pytest.mark.parametrize(("age", "own"), [(5400, True), (32400, True), (5399, False), (32401, False)])
def test_band_edges_of_six_hours(spark, age, own):
    one, six = rates(spark, [at(0, 0), at(age, 10)])[-1]
    want = 10 / (age / 3600)
    assert abs(six - want) < 1e-6 and abs(one - want) < 1e-6


def test_six_hours_copies_the_rate_before_clipping(spark):
    assert rates(spark, [at(0, 0), at(900, 29)])[-1] == (50.0, 50.0)


@pytest.mark.parametrize(("step", "crossed"), [(-30, True), (-30.01, False)])
def test_barrier_is_strict(spark, step, crossed):
    assert (rates(spark, [at(0, 60), at(3600, 60 + step)])[-1][0] != 0) == crossed


@pytest.mark.parametrize(("step", "cycle"), [(-35, 0), (-35.01, 1)])
def test_reset_is_strict(spark, step, cycle):
    assert X.add_reset_features(log(spark, [at(0, 60), at(3600, 60 + step)])).agg(F.max("cycle_id")).first()[0] == cycle


def test_given_cycles_stay(spark):
    x = X.add_reset_features(log(spark, [at(0, 90), at(3600, 1)], cycle_id=F.lit(7)))
    assert {r.cycle_id for r in x.collect()} == {7}


def test_rates_equal_a_backward_walk(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(120):
        t += rng.choice([60, 300, 900, 1800, 3000, 3600, 4200, 7200, 20000])
        rows.append((t, rng.uniform(0, 100)))

    def walk(i):
        best = {1: None, 6: None}
        for j in range(i - 1, -1, -1):
            if rows[j + 1][1] - rows[j][1] < -30:
                break
            dt = rows[i][0] - rows[j][0]
            for k, lo, mid, hi in ((1, 900, 3600, 7200), (6, 5400, 21600, 32400)):
                if lo <= dt <= hi and (best[k] is None or abs(dt - mid) < best[k][0]):
                    best[k] = (abs(dt - mid), j)
        prev = rows[i][0] - rows[i - 1][0]
        if best[1] is None and 60 <= prev <= 86400 and rows[i][1] - rows[i - 1][1] >= -30:
            best[1] = (0, i - 1)
        rate = lambda b: 0.0 if b is None else (rows[i][1] - rows[b[1]][1]) / ((rows[i][0] - rows[b[1]][0]) / 3600)
        one = rate(best[1])
        six = rate(best[6]) if best[6] else one
        return tuple(round(max(-50, min(50, x)), 6) for x in (one, six))

    want = [(0.0, 0.0)] + [walk(i) for i in range(1, len(rows))]
    got = rates(spark, [at(t, f) for t, f in rows])
    assert [x for p in got for x in p] == pytest.approx([x for p in want for x in p])


def test_input_order_does_not_matter(spark):
    df = log(spark, [at(h * 1800, (h * 13) % 100) for h in range(60)])
    key = lambda d: sorted(map(repr, X.build_feature_table(d).select("ts", *X.FEATURES).collect()))
    assert key(df) == key(df.orderBy(F.rand(1)).repartition(3))


def test_one_exchange_and_no_python(spark):
    plan = X.build_feature_table(log(spark, [at(0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Join" not in plan


def test_labels(spark):
    f = X.add_reset_features(log(spark, [at(0, 10), at(3600, 89.99), at(7200, 90), at(10800, 95), at(14400, 5), at(18000, 80)]))
    x = L.build_labels(f, drop_censored=False).orderBy("ts").collect()
    assert [r.time_to_overflow_hours for r in x] == [2.0, 1.0, 0.0, 0.0, None, None]
    assert [r.risk_level for r in x] == ["Critical"] * 4 + ["Low"] * 2
    assert L.build_labels(f).count() == 4


def test_risk_bounds(spark):
    hours = [0, 3.99, 4, 12, 24, -1, None, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(None if h is None else float(h), i) for i, h in enumerate(hours)], "h double, i int").orderBy("i").select(L.risk_level(F.col("h"))).collect()]
    assert got == ["Critical", "Critical", "High", "Medium", "Low", "Low", "Low", "Low", "Low"]


def test_purge_is_strict(spark):
    rows = [("2026-01-01 00:00:00", "2026-01-02 00:00:00"), ("2026-01-01 00:00:00", "2026-01-02 00:00:01"), ("2026-01-02 00:00:00", None), ("2026-01-03 00:00:00", "2027-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "ts string, crossing_ts string").select(*[F.col(c).cast("timestamp").alias(c) for c in ("ts", "crossing_ts")])
    x = L.chronological_split(df, "2026-01-02", "2026-01-03")
    assert [r.split for r in x.collect()] == ["train", "train", "val", "test"]
    assert L.purge_label_leakage(x, "2026-01-02", "2026-01-03").count() == 3


def test_naive_without_rate(spark):
    df = spark.createDataFrame([(50.0, 0.0), (80.0, -5.0), (95.0, 1.0), (None, 1.0)], "fill_pct double, fill_rate_1h double")
    assert [r.naive_hours for r in L.naive_forecast(df).collect()] == [40.0, 2.0, 0.0, 40.0]


DAY = "2026-03-19"


def one(spark, rows, decision="2026-03-19T12:00:00Z", extra=None, **options):
    return S.snapshot(log(spark, rows, **(extra or {})), decision, **options).collect()


def test_snapshot_statuses(spark):
    two = [(f"{DAY} 10:00:00", 20), (f"{DAY} 11:00:00", 30)]
    assert one(spark, two)[0].status == "available"
    assert one(spark, two[:1])[0].status == "cold_start"
    assert one(spark, [("bin_01", t, f, 0) for t, f in two])[0].status == "low_confidence"
    stale = one(spark, two, "2026-08-28T11:00:00Z")[0]
    assert stale.status == "stale" and stale.time_to_service_threshold_hours is not None and stale.reason
    assert one(spark, two[:1], "2026-08-28T11:00:00Z")[0].status == "stale"
    u = one(spark, two, threshold=100.0)[0]
    assert (u.status, u.bin_id, u.time_to_service_threshold_hours, u.fill_pct) == ("unsupported_threshold", "bin_01", None, 30.0)
    assert {r.status for r in one(spark, two, "2026-01-02T12:00:00Z", available_after="2026-03-16")} == {"model_unavailable"}
    assert one(spark, two, bins=["x"], threshold=100.0)[0].status == "unavailable"


def test_stale_is_strict(spark):
    two = [("2026-03-16 11:00:00", 20), ("2026-03-16 12:00:00", 30)]
    assert one(spark, two)[0].status == "available"
    assert one(spark, two, "2026-03-19T12:00:01Z")[0].status == "stale"


def test_same_time_twice_is_no_cold_start(spark):
    assert one(spark, [(f"{DAY} 11:00:00", 20), (f"{DAY} 11:00:00", 30)])[0].status == "available"


def test_point_in_time(spark):
    rows = [(f"{DAY} 10:00:00", 20), (f"{DAY} 11:00:00", 30), (f"{DAY} 12:00:00", 40)]
    r = one(spark, rows, "2026-03-19T11:00:00Z", snapshot_id="s1")[0]
    assert (r.fill_pct, r.status, r.input_snapshot_id) == (30.0, "available", "s1")
    late = {"received_at": F.when(F.col("seq") == 0, F.lit("2026-03-19 10:00:01")).when(F.col("seq") == 1, F.lit("2026-03-19 12:00:00")).cast("timestamp")}
    r = one(spark, rows, "2026-03-19T11:30:00Z", late)[0]
    assert (r.fill_pct, r.status) == (20.0, "cold_start")
    assert one(spark, rows, "2026-03-19T10:00:00Z")[0].fill_pct == one(spark, rows, "2026-03-19T18:00:00+08:00")[0].fill_pct


def test_later_rows_change_nothing(spark):
    rows = [(f"{DAY} {h:02d}:00:00", 5 * h) for h in range(10)]
    a, b = one(spark, rows[:6], f"{DAY}T05:30:00Z"), one(spark, rows, f"{DAY}T05:30:00Z")
    assert a == b


def test_every_configured_bin_once(spark):
    rows = [("bin_01", f"{DAY} 10:00:00", 10, 1), ("bin_01", f"{DAY} 11:00:00", 20, 1), ("bin_02", f"{DAY} 11:00:00", 20, 1)]
    got = {r.bin_id: r.status for r in one(spark, rows, bins=["bin_01", "bin_02", "bin_03"])}
    assert got == {"bin_01": "available", "bin_02": "cold_start", "bin_03": "unavailable"}


def test_no_bins_gives_one_row(spark):
    r = S.snapshot_or_none(log(spark, [at(0, 1)]).where("false"), "2026-03-19T12:00:00Z").collect()
    assert [(x.bin_id, x.status) for x in r] == [(None, "invalid_input")]


def test_horizons_never_invent_a_probability(spark):
    h = one(spark, [(f"{DAY} 10:00:00", 50), (f"{DAY} 11:00:00", 60)])[0].horizons
    assert set(h) == {"6", "24", "48", "168"}
    assert all(v.overflow_probability is None and v.overflow_probability_status == "unsupported" for v in h.values())
    assert (h["6"].expected_growth_pct_points, h["6"].expected_fill_pct) == (60.0, 100.0)


@pytest.mark.parametrize("waste", ["general", "plastic", "metal", "glass"])
def test_waste_type_is_echoed(spark, waste):
    r = one(spark, [(f"{DAY} 10:00:00", 40), (f"{DAY} 11:00:00", 50)], extra={"waste_type": F.lit(waste)})[0]
    assert (r.waste_type, r.waste_type_used_as_feature) == (waste, False)


def test_fitted_models_beat_the_rule(spark):
    """A learnable log: each bin and hour has its own steady rate."""
    from fillwatch.operators import models as M

    rows = []
    for b, rate in itertools.product(range(4), [0]):
        fill = 0.0
        for h in range(24 * 40):
            fill += (b + 1) * (2.0 if 8 <= h % 24 < 20 else 0.3) + rate
            if fill > 99:
                fill = 0.0
            rows.append((f"b{b}", f"2026-{1 + h // 24 // 28:02d}-{1 + h // 24 % 28:02d} {h % 24:02d}:00:00", fill, 1))
    x = L.chronological_split(L.build_labels(X.build_feature_table(log(spark, rows))), "2026-01-25", "2026-02-03").cache()
    metrics, chosen, fitted = M.train_and_compare(x, "2026-01-25", "2026-02-03", {"linear": {}, "forest": {"numTrees": 10, "maxDepth": 8}})
    test = {r.model: r.mae_hours for r in metrics.where("split = 'test'").collect()}
    assert chosen == "forest" and test["forest"] < min(test["naive"], test["linear"])
    m = M.manifest(x, metrics, chosen, "2026-01-25", "2026-02-03").first()
    assert len(m.sha256_checksum) == 64 and m.estimator == "forest"
    assert M.feature_importance(fitted["forest"], spark).count() == 10


def test_one_exchange_in_registered_queries(spark):
    """Features cost one exchange and one scan from the adapter on; so does a grid's log, whatever the number of decisions."""
    import os

    from fillwatch.plans import telemetry

    if not os.path.isdir(d := "/root/testdata/sf0.001"):
        pytest.skip("the supplied tables aren't there")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, sorts in (("nearest_lookback", 2), ("feature_table", 3), ("label_cycles", 5)):
        p = plan(telemetry.QUERIES[name](spark, d))
        assert (p.count("Exchange hashpartitioning"), p.count("FileScan")) == (1, 1) and p.count("Sort [") <= sorts, name
    log = telemetry.readings_dup(spark, d)
    for decisions in (telemetry.DECISIONS[:2], telemetry.DECISIONS):
        p = plan(S.known_pairs(log, decisions))
        assert (p.count("Exchange hashpartitioning"), p.count("FileScan")) == (1, 1)
    assert plan(S.snapshot(log, telemetry.DECISION)).count("Exchange hashpartitioning") == 1


def test_grid_equals_snapshots(spark):
    """Late, repeated and never received readings: every pair of the grid is the snapshot's."""
    rng = random.Random(9)
    rows = [(f"b{rng.randrange(4)}", f"{DAY} {h:02d}:{m:02d}:00", float(rng.randrange(100)), rng.randrange(2)) for h in range(24) for m in (0, 20, 40) for _ in range(rng.randrange(1, 4))]
    wait = (F.col("seq") * 7919 % 300).cast("long")
    df = log(spark, rows, received_at=F.when(F.col("seq") % 11 > 0, F.timestamp_micros(F.unix_micros("ts") + F.when(F.col("seq") % 3 == 0, wait).otherwise(0) * 60_000_000)), waste_type=F.when(F.col("seq") % 5 == 0, F.concat(F.lit("w"), F.col("seq").cast("string"))))
    times, bins = [f"{DAY}T{h:02d}:10:00Z" for h in range(0, 24, 3)], ["b0", "b1", "b2", "b3", "b9"]
    got = sorted(map(repr, S.snapshot_grid(df, times, bins).collect()))
    assert got == sorted(repr(r) for t in times for r in S.snapshot(df, t, bins).collect())
    assert len(got) == 40


def test_grid_without_columns(spark):
    df = log(spark, [(f"{DAY} 10:00:00", 20), (f"{DAY} 11:00:00", 30)])
    for gone in ("fill_pct", "ts"):
        assert [r.status for r in S.snapshot_grid(df.drop(gone), [f"{DAY}T12:00:00Z", f"{DAY}T13:00:00Z"]).collect()] == ["missing_required_columns"] * 2
    assert [r.status for r in S.snapshot_grid(df.drop("fill_pct"), [f"{DAY}T12:00:00Z"], threshold=75.0).collect()] == ["unsupported_threshold"]
    assert [(r.bin_id, r.status) for r in S.snapshot_grid(df.where("false"), [f"{DAY}T12:00:00Z"]).collect()] == [(None, "invalid_input")]
