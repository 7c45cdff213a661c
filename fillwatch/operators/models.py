"""Model fitting, selection and comparison with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.operators.boosting import Boosted, fit_boosted
from fillwatch.operators.features import FEATURES
from fillwatch.operators.labels import evaluate, leaks_label, naive_forecast, select_model
from fillwatch.session import stored

#: Full sizes; the forest needs several GB of driver memory at these.
FOREST = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5, "seed": 42}
BOOSTED = {"rounds": 200, "depth": 6, "rate": 0.05, "rows": 0.8, "columns": 0.8, "seed": 42}
GBT = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
#: Of what is fitted, what may be selected, ties to the first.
ORDER = ["forest", "boosted"]


def fit(train: DataFrame, kind: str, label: str = "time_to_overflow_hours", features: list[str] = FEATURES, **params) -> PipelineModel | Boosted:  # noqa: ANN003
    """The ten features (or others) and one regressor: linear, forest, boosted (second order, columns drawn per tree) or gbt (Spark's)."""
    if kind == "boosted":
        return fit_boosted(train, features, label, **BOOSTED | params)
    train = stored(train.select(*features, label), "train")  # a fit passes over its rows many times
    common = {"labelCol": label, "featuresCol": "features", "predictionCol": "predicted_hours"}
    if kind == "linear":
        model = LinearRegression(**common | params)
    elif kind == "forest":
        model = RandomForestRegressor(**common | FOREST | {"featureSubsetStrategy": "all"} | params)
    elif kind == "gbt":
        model = GBTRegressor(**common | GBT | params)
    else:
        raise ValueError(f"no such model: {kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring: predicted hours as the model gives them; snapshot() turns negative ones into model_error."""
    return model.transform(df).drop("features")


def scorer(model: PipelineModel):  # noqa: ANN201
    """For snapshot(): adds `hours`."""
    return lambda latest: model.transform(latest).drop("features").withColumnRenamed("predicted_hours", "hours")


def train_and_compare(labeled: DataFrame, val_from: str, test_from: str, params: dict[str, dict] | None = None) -> tuple[DataFrame, str, dict[str, PipelineModel]]:
    """Fit on purged train, select forest or boosted on purged val, report on untouched test: (metrics, selected name, models).

    labeled needs `split` (chronological_split). The rows are computed once and read from the shared
    folder by every fit. All predictions go through one long table and one aggregate.
    """
    params = params or {"linear": {}, "forest": {}, "boosted": {}}
    clean = stored(labeled.where(~leaks_label(val_from, test_from)), "labeled")  # every model fits and scores it; its windows run once
    train = clean.where("split = 'train'")
    models = {k: fit(train, k, **p) for k, p in params.items()}
    cols = ["split", "time_to_overflow_hours", "predicted_hours"]
    held = clean.where("split <> 'train'")
    long = naive_forecast(held).withColumnRenamed("naive_hours", "predicted_hours").select(F.lit("naive").alias("model"), *cols)
    for k, m in models.items():
        long = long.unionByName(score(m, held).select(F.lit(k).alias("model"), *cols))
    both = evaluate(long.withColumn("model", F.concat_ws("/", "split", "model")))
    both = both.select(F.split("model", "/")[0].alias("split"), F.split("model", "/")[1].alias("model"), *both.columns[1:])
    val = both.where("split = 'val'").where(F.col("model").isin(*models))
    chosen = select_model(val, ORDER).first()
    return both, chosen.model if chosen else "naive", models


def feature_importance(model: PipelineModel, spark) -> DataFrame:  # noqa: ANN001
    """(feature, importance), largest first."""
    v = model.importance if isinstance(model, Boosted) else model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(FEATURES, v, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def manifest(labeled: DataFrame, metrics: DataFrame, selected: str, val_from: str, test_from: str, version: str = "1") -> DataFrame:
    """One row: cut-offs, row counts by split with what the purge took, target, metrics as JSON, and a checksum of it all."""
    n = labeled.groupBy("split").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(leaks_label(val_from, test_from)).alias("n_purged"))
    counts = n.agg(F.to_json(F.array_sort(F.collect_list(F.struct("split", "n_raw", "n_purged")))).alias("counts"))
    m = metrics.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*metrics.columns)))).alias("metrics"))  # one row a model and split
    x = counts.join(F.broadcast(m)).select(F.lit(version).alias("model_version"), F.lit(selected).alias("estimator"), F.lit(val_from).alias("val_from"), F.lit(test_from).alias("test_from"), F.array(*map(F.lit, FEATURES)).alias("feature_columns"), F.lit(90.0).alias("threshold"), "counts", "metrics")
    return x.withColumn("sha256_checksum", F.sha2(F.to_json(F.struct(*x.columns)), 256))
