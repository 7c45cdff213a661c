"""Operator 9: cross-site line dedup by distinct-site spread (sketches first, exact counts near the threshold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import materialise, sized

MIN_SITES, LG_K, BAND = 10, 10, 0.5


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(h, first_doc) of the lines that stand in min_sites sites or more.

    lines has (doc_id, site, h). One mergeable HyperLogLog sketch of the sites per line hash. Estimates beyond
    min_sites * (1 +- band) decide at once (with 2^10 registers that is over ten standard errors); lines in between
    get exact distinct counts, in two aggregation steps so that a common line is combined before each shuffle.
    """
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = materialise(spread.where(F.col("estimate") >= min_sites * (1 - band)), "spread")
    near = spread.where(F.col("estimate") <= min_sites * (1 + band)).select("h")
    exact = lines.select("h", "site").join(sized(near), "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("site").alias("sites"))
    exact = exact.where(F.col("sites") >= min_sites).select("h")
    sure = spread.where(F.col("estimate") > min_sites * (1 + band))
    return materialise(sure.select("h", "first_doc").union(spread.hint("merge").join(exact, "h", "left_semi").select("h", "first_doc")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, kept, n_lines, n_removed, site, carried columns) for every row, without its cross-site boilerplate lines.

    A line is what stands between line feeds, without spaces at its ends; its key is its XXH64. A non-empty line in
    min_sites or more distinct sites goes from every document but the one with the smallest id that has it, so that
    no line is lost to the corpus. Null texts count as empty (one empty line); empty lines are never removed; a
    null site is no site; a null id is larger than any (its line goes if a document with an id has it, else it stays); rows repeated with one id
    keep their lines together; columns to carry through are named in carry, others are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    split = rows.select("doc_id", "site", F.split("text", "\n", -1).alias("all"))
    lines = split.select("doc_id", "site", F.explode_outer("all").alias("line")).select("doc_id", "site", F.trim("line").alias("line")).where("line <> ''").select("doc_id", "site", F.xxhash64("line").alias("h"))
    gone = line_spread(lines, min_sites)
    hits = lines.select("doc_id", "h").join(sized(gone), "h").where("first_doc IS NOT NULL AND (doc_id IS NULL OR doc_id > first_doc)").select("doc_id", "h").distinct()
    per_doc = materialise(hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set("h").alias("gone")), "hits")
    joined = rows.hint("merge").join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    also = ["site", *[f"carried_{c}" for c in carry]]
    parts = joined.select("doc_id", "text", *also, F.split("text", "\n", -1).alias("all"), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: (F.trim(x) == "") | ~F.array_contains("gone", F.xxhash64(F.trim(x)))))
    out = parts.select("doc_id", "text", *also, "all", kept.alias("left"))
    names = ["site", *[F.col(f"carried_{c}").alias(c) for c in carry]]
    return out.select("doc_id", "text", F.array_join("left", "\n").alias("kept"), F.size("all").cast("long").alias("n_lines"), (F.size("all") - F.size("left")).cast("long").alias("n_removed"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_kept_chars"), F.md5("kept").alias("kept_md5"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i, ls[i] AS raw, trim(ls[i], ' ') AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
s AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.*, s.line IS NOT NULL AND l.doc_id > s.first_doc AS gone FROM l LEFT JOIN s ON l.line = s.line),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS n_kept_chars, md5(kept) AS kept_md5 FROM o
"""
