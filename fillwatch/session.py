"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "fillwatch", **conf: str) -> SparkSession:
    """Time zone UTC and adaptive execution; all else is the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode alone, a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fillwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: what several plans read is computed once, and lost executors cost no lineage."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitting(df: DataFrame, most: int = 200_000) -> DataFrame:
    """With a broadcast hint if df has no more rows than that (it looks at no more), else with a merge-join hint."""
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df.hint("merge")


#: Rows that a task of a window gets on average at most.
TASK_ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df by keys in as many partitions as its counted rows ask for, if the session's own number would give a task more than `rows`.

    A window by the same keys then needs no other exchange, and what a task holds doesn't grow with the table.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
