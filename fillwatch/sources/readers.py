"""Reading and writing of logs, stage tables, metrics, manifests, artifacts and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("bin_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("fill_pct", T.DoubleType()), T.StructField("confidence_flag", T.IntegerType()),
    T.StructField("received_at", T.TimestampType()), T.StructField("waste_type", T.StringType()), T.StructField("seq", T.LongType()),
])
OPTIONAL = ("confidence_flag", "received_at", "waste_type")


def to_utc(column: str = "ts") -> Column:
    """An ISO time as an instant: without offset it is UTC, which is the session's zone; what is no time becomes null."""
    return F.try_to_timestamp(F.col(column).cast("string"))


def conform(df: DataFrame, schema: T.StructType = READINGS) -> DataFrame:
    """df with the columns of the log in their types, and of the optional ones those that it has.

    Absent and null differ, so absent ones are not added: without received_at there is no receipt filter, while a null
    one drops the row; without confidence_flag readings count as good. NaN levels become null, identities become text;
    without seq, rows count in the order in which they were read.
    """
    out = df.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in df.columns else df
    texts = {c for c, kind in df.dtypes if kind == "string"}
    for f in schema:
        if f.name in out.columns:
            value = to_utc(f.name) if f.name in texts and f.dataType == T.TimestampType() else F.col(f.name).cast(f.dataType)
            out = out.withColumn(f.name, value)
        elif f.name not in OPTIONAL:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.withColumn("fill_pct", F.nanvl("fill_pct", F.lit(None).cast("double")))


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The sensor log; CSV files need a header line."""
    reader = spark.read.options(**options)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return conform(raw)


def write_stage(df: DataFrame, path: str, ts: str = "ts", mode: str = "overwrite") -> None:
    """A feature or label table, partitioned by day so that later reads prune; a day is written by as many tasks as its bins fill."""
    df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def write_stage_table(df: DataFrame, table: str, path: str, buckets: int = 64, ts: str = "ts") -> DataFrame:
    """A stage as a table bucketed by bin and sorted by bin and time within each file, and read again.

    Windows and joins by bin need no exchange over it, and as a file's row groups hold neighbouring bins, a filter by bin
    skips most of them. One exchange writes it; one file a bucket.
    """
    dealt = df.repartition(buckets, "bin_id").sortWithinPartitions("bin_id", ts)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "bin_id").sortBy("bin_id", ts).saveAsTable(table)
    return df.sparkSession.table(table)


def write_metrics(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """(path, manifest): whole JSON files as text, one row a file."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("manifest"))


def read_feature_lists(spark: SparkSession, glob: str) -> DataFrame:
    """(path, features): JSON files with an array of names, one row a file; null where a file holds none."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<string>").alias("features"))


def scan_artifacts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, sha256) of binary files."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): versioned application documents as JSON text, one a line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
