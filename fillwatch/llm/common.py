"""What the corpus operators share: shared-folder tables, null-safe helpers and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.session import shared_dir

#: ASCII white space only, so that every engine splits words alike.
WORD = r"[^\x20\x09-\x0D]+"


#: crc_.tab, the table of crc32 by its bits, as common table expressions of a recursive query; DuckDB has no such function.
CRC_SQL = r"""
 bits_(i, v, k) AS (SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits_ WHERE k < 8),
 crc_(tab) AS (SELECT list(v ORDER BY i) FROM bits_ WHERE k = 8),
"""


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL, where crc_ is joined."""
    return f"xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split({text}, '')]), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295)"


#: Drops the shuffle files of a finished write, whose result stands in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes.

    Tables that a result may still read stay in the folder, which is the cluster's to clear after the application.
    """
    return _write(df, tag)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, most: int, weight: Column | None = None) -> bool:
    """Whether df has at most so many rows (looks at no more than that), or its rows at most so much weight in all."""
    if weight is None:
        return df.limit(most + 1).count() <= most
    return (df.agg(F.sum(weight)).first()[0] or 0) <= most


def sized(df: DataFrame, most: int = 200_000, weight: Column | None = None) -> DataFrame:
    """A table with a broadcast hint if its counted rows, or the weight of wide ones, fit the bound, else with a merge-join hint."""
    return F.broadcast(df) if small_enough(df, most, weight) else df.hint("merge")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest node reachable.

    Alternates the large-star and small-star steps (each a min per node and a join back), so rounds grow with the
    logarithm of the graph's size; every round is written out, which bounds lineage, and replaces the one before. Only a
    row count and a checksum come to the driver. A graph that isn't done after max_rounds is an error. Nodes without
    edges, self-loops and null ends are left out; no edges give an empty table.
    """
    spark = edges.sparkSession
    now, path = _write(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen, rounds = mark(now), 0
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.hint("merge").join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, half = _write(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low, "u")
        old = path
        now, path = _write(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(spark, old)
        discard(spark, half)
        was, seen, rounds = seen, mark(now), rounds + 1
        if was == seen:
            break
        if rounds == max_rounds:
            raise RuntimeError(f"components aren't complete after {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
