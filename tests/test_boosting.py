"""Boosted trees against a plain twin, Spark's own and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwatch.operators import boosting, models


def plain_boost(x, y, key, edges, rounds, depth, rate, rows, columns, l2, least, seed):
    """The same trees by recursion over arrays of rows; columns and rows are drawn by the same rules."""
    rng, pred = np.random.default_rng(seed), np.full(len(y), y.mean())
    b = np.array([[sum(e < v for e in es) for v in c] for es, c in zip(edges, x.T, strict=True)]).T
    for t in range(rounds):
        use = np.sort(rng.choice(x.shape[1], max(1, round(columns * x.shape[1])), replace=False))
        seen = boosting.drawn(key, t, rows, seed)
        grad, add = pred - y, np.zeros(len(y))

        def grow(rows_, left):
            s = rows_ & seen
            if not s.any():
                return
            add[rows_] = -rate * grad[s].sum() / (s.sum() + l2)
            best = (1e-12, None)
            for f in use:
                for cut in range(len(edges[f])):
                    a, c = s & (b[:, f] <= cut), s & (b[:, f] > cut)
                    if a.sum() >= least and c.sum() >= least:
                        gain = grad[a].sum() ** 2 / (a.sum() + l2) + grad[c].sum() ** 2 / (c.sum() + l2) - grad[s].sum() ** 2 / (s.sum() + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
            if left and best[1]:
                f, cut = best[1]
                grow(rows_ & (b[:, f] <= cut), left - 1)
                grow(rows_ & (b[:, f] > cut), left - 1)

        grow(np.ones(len(y), bool), depth)
        pred = pred + add
    return pred


@pytest.mark.parametrize(("rows", "columns", "least"), [(1.0, 1.0, 1.0), (0.7, 0.67, 5.0)])
def test_equal_to_the_plain_twin(spark, rows, columns, least):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (300, 3)), 2)
    y = np.round(3 * (x[:, 0] > 0.2) * x[:, 1] + x[:, 2] ** 2 + rng.normal(0, 0.1, 300), 3)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(3)
    edges = [[-1.0, -0.3, 0.2, 0.8], [-0.7, 0.0, 0.7], [-1.5, -0.5, 0.5, 1.5]]
    how = {"rounds": 12, "depth": 3, "rate": 0.3, "rows": rows, "columns": columns, "l2": 1.0, "least": least, "seed": 7}
    model = boosting.fit_boosted(df, ["a", "b", "c"], "y", edges=edges, **how)
    got = sorted((r.a, r.b, r.c, r.predicted_hours) for r in model.transform(df).collect())
    keyed = df.select("a", "b", "c", "y", F.xxhash64("a", "b", "c", "y").alias("k")).collect()
    want = plain_boost(np.array([r[:3] for r in keyed]), np.array([r.y for r in keyed]), np.array([r.k for r in keyed]), edges, **how)
    assert np.array(got) == pytest.approx(np.array(sorted((*r[:3], p) for r, p in zip(keyed, want, strict=True))), abs=1e-9)
    assert len(model.trees) == 12 and sum(model.importance) == pytest.approx(1)


def test_no_worse_than_first_order_trees(spark):
    """On held-out rows of a curved function, at equal size."""
    df = spark.range(3000).select(*[(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0).alias(f) for k, f in enumerate(models.FEATURES)], "id")
    df = df.withColumn("time_to_overflow_hours", 20 * F.sin(5 * F.col("fill_pct")) + 30 * F.col("fill_rate_1h") * F.col("fill_rate_6h") + F.col("hour_sin") + 40)
    train, held = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    error = lambda m: models.score(m, held).agg(F.avg(F.abs(F.col("predicted_hours") - F.col("time_to_overflow_hours")))).first()[0]
    ours, theirs = models.fit(train, "boosted", rounds=15, depth=4, rate=0.3), models.fit(train, "gbt", maxIter=15, maxDepth=4, stepSize=0.3)
    assert error(ours) <= error(theirs) * 1.02
    top = models.feature_importance(ours, spark).collect()
    assert {r.feature for r in top[:3]} == {"fill_pct", "fill_rate_1h", "fill_rate_6h"}


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (5.0, 9.0), (6.0, 9.0), (7.0, None)], "a double, y double")
    m = boosting.fit_boosted(df, ["a"], "y", rounds=30, depth=1, rate=0.5, rows=1.0, l2=0.0, edges=[[1.0]])
    assert [round(r.predicted_hours, 3) for r in m.transform(df).collect()] == [1.0, 1.0, 9.0, 9.0, 9.0]
    none = boosting.fit_boosted(df.where("false"), ["a"], "y", rounds=2, edges=[[1.0]])
    assert [r.predicted_hours for r in none.transform(df).collect()] == [0.0] * 5
