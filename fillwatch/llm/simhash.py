"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import components, materialise

SEED, BITS, SHINGLE = 42, 64, 3


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 majority bits over XXH64 of the word shingles; texts shorter than a shingle hash whole, none gives zero."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, digest, n = b" ".join(words), xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    behind = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.r_[0, behind][:n], behind[min(size, len(words)) - 1 :] - 1
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, n, step):
        part = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist(), strict=True)), "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row; null text counts as empty. Texts stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", size) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64) * (i == 63)


def ball(fp: Column) -> Column:
    """All variants within half the radius (one flip): (variant, bit mask of the flip, 1 for the unflipped one)."""
    flips = [F.struct(fp.bitwiseXOR(F.lit(_bit(i)).cast("long")).alias("variant"), F.lit(_bit(i)).cast("long").alias("mask"), F.lit(0).alias("own")) for i in range(BITS)]
    return F.array(F.struct(fp.alias("variant"), F.lit(0).cast("long").alias("mask"), F.lit(1).alias("own")), *flips)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at two or fewer differing bits, as stars within each bucket.

    A bucket holds the fingerprints at one flip or less from its variant: 65 at most, each known by the bit it
    flips, so a bucket is one OR of bits. Any two of its members differ in two bits or fewer, so a star on one member
    links the same components as all pairs would, and no pair within the radius lacks a common bucket.
    """
    balls = distinct.select(F.explode(ball(F.col("fp"))).alias("x")).select("x.*")
    buckets = balls.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") > 1)
    flipped = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("mask", i) == 1),
        lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    members = F.when(F.col("own") == 1, F.concat(F.array("variant"), flipped)).otherwise(flipped)
    pairs = buckets.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Equal fingerprints are grouped before anything is emitted, so a group of copies costs one ball. component_id is
    the smallest doc_id reachable by links. Null or empty texts have fingerprint zero and link like any other; rows
    with a null id get the component of their fingerprint (null if it has no other); repeated rows stay repeated;
    other columns are ignored; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    linked = materialise(components(links(distinct)), "linked")
    place = distinct.hint("merge").join(linked, distinct.fp == linked.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    place = materialise(place, "place")
    least = place.groupBy("c").agg(F.min("rep").alias("component_id"))
    final = materialise(place.hint("merge").join(least, "c").select("fp", "component_id"), "final")
    return fps.hint("merge").join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
