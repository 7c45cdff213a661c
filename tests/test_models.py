"""Models against a plain fit, and what is chosen among them."""

import numpy as np
from pyspark.sql import functions as F

from fillwatch.operators import models as M
from fillwatch.operators.features import FEATURES


def table(spark, n=240):
    """Hours that hang on the level and the rate; three splits, none leaking."""
    rng = np.random.default_rng(1)
    x = rng.random((n, len(FEATURES)))
    y = 5 + 30 * x[:, 0] - 8 * x[:, 1]
    rows = [(*map(float, x[i]), float(y[i]), ("train", "val", "test")[i % 3], i) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", time_to_overflow_hours double, split string, i long")
    return df.withColumn("crossing_ts", F.lit(None).cast("timestamp")), x, y


def test_linear_fit_equals_least_squares(spark):
    df, x, y = table(spark)
    y = y + np.sin(np.arange(len(y)))
    noisy = df.withColumn("time_to_overflow_hours", F.col("time_to_overflow_hours") + F.sin("i"))
    model = M.fit(noisy.where("split = 'train'"), "linear")
    at = np.arange(len(y)) % 3 == 0
    w, *_ = np.linalg.lstsq(np.c_[x[at], np.ones(at.sum())], y[at], rcond=None)
    got = {r.i: r.predicted_hours for r in M.score(model, noisy).collect()}
    assert np.allclose([got[i] for i in range(len(y))], np.c_[x, np.ones(len(y))] @ w, atol=1e-6)
    low = M.score(model, noisy.withColumns({FEATURES[0]: F.lit(-5.0)})).agg(F.max("predicted_hours")).first()[0]
    assert low < 0  # as the model gives it


def test_comparison_chooses_by_validation_error(spark):
    df, x, y = table(spark)
    small = {"linear": {}, "forest": {"numTrees": 5, "maxDepth": 3}, "boosted": {"rounds": 20, "depth": 3, "rate": 0.3}}
    both, chosen, fitted = M.train_and_compare(df, "2024-01-21", "2024-01-26", small)
    mae = {(r.split, r.model): r.mae_hours for r in both.collect()}
    assert mae["val", "linear"] < 0.01 and chosen == min(("forest", "boosted"), key=lambda k: mae["val", k])
    held = np.arange(len(y)) % 3 == 1
    for kind in small:
        p = np.array([r.predicted_hours for r in M.score(fitted[kind], df.where("split = 'val'")).orderBy("i").collect()])
        assert abs(mae["val", kind] - np.abs(p - y[held]).mean()) <= 0.0005 + 1e-9
    top = M.feature_importance(fitted["forest"], spark).collect()
    assert top[0].feature == FEATURES[0] and top[0].importance > 0.5
    (m,) = M.manifest(df, both, chosen, "2024-01-21", "2024-01-26").collect()
    assert m.estimator == chosen and len(m.sha256_checksum) == 64 and list(m.feature_columns) == FEATURES and '"split":"val","n_raw":80' in m.counts
