"""A corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination, mixing.

Every stage works on all that the stage before kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm import decontam, linededup, mixing, nearcopies, toxicity
from fillwatch.llm.common import materialise, sized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; null and empty texts stay. Labels come from sf_dir.

    Each row is judged by its own text, so repeated rows share their fate; without labels of both kinds all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("toxicity", toxicity.toxic_score(model, F.col("text"))).where("toxicity < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sources (but in the first document that has them).

    Null texts become empty; a null source is no source; see line_dedup for rows without an id and repeated ones.
    """
    out = linededup.line_dedup(docs, carry=("lang",))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", F.col("site").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group at a Jaccard similarity of 0.8 or more of 5-word shingles.

    Rows repeated with one id stay or go by their own texts; texts without words, and rows without an id that no row
    with one is linked to, stay.
    """
    return nearcopies.drop_near_copies(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item. Each row is judged by its own text; rows and items without an id count too."""
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id"), "text")
    bad = materialise(decontam.leaks(rows, items, id_col="row").select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return rows.join(sized(bad), "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the final mixture with their number of copies; see mixing.mix for nulls, ties and repeated rows."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix)]

#: The first stage trains a model, which SQL can't express; tests compare the others with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
