"""Operator 10: mixing sources to target weights by hierarchical budgeting over domain, language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import WORD, materialise, sized

#: Production parameters. Weights are relative among siblings; what is not named has weight 1.
DOMAINS = ("web", "books", "code", "forum")
DOMAIN_WEIGHTS = {"web": 4.0, "books": 3.0, "code": 2.0, "forum": 1.0}
LANG_WEIGHTS = {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SHARE, MAX_EPOCHS, SEED = 0.8, 2, "7"
BUCKET_ROWS = 512


def domain_of(source: Column) -> Column:
    """The domain of a source, by the number at its end modulo 4; sources without a number are the first domain's."""
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (n % len(DOMAINS) + 1).cast("int"))


def _weight(table: dict[str, float], key: str) -> Column:
    out = F.lit(1.0)
    for k, w in table.items():
        out = F.when(F.col(key) == k, F.lit(w)).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Share each parent's `budget` among its children by `weight`, none above its `cap`; adds `got`.

    The closed form of repeated redistribution: with children in order of cap/weight, one is full as long as its
    proportional part of what is left reaches its cap; the rest share what then remains. Shortages thus go to siblings;
    an ancestor sees them only through the parent's own cap. Children of weight 0 get nothing, nor do they count to it.
    """
    w = Window.partitionBy(*parent).orderBy(F.coalesce(F.try_divide(F.col("cap"), F.col("weight")), F.lit(float("inf"))), *order)
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    x = children.withColumn("b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("ww", F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("full", (F.col("weight") > 0) & (F.col("cap") * F.col("ww") <= F.col("weight") * F.col("b")))
    x = x.withColumn("bb", F.max(F.when(~F.col("full"), F.struct(F.col("ww"), F.col("b")))).over(whole))
    return x.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.try_divide(F.col("weight") * F.col("bb.b"), F.col("bb.ww")), F.lit(0.0)))).drop("b", "ww", "full", "bb")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with their `budget` in tokens: the total is share of all tokens."""
    L = ["domain", "lang", "source"]
    x = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    langs = x.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    doms = langs.groupBy("domain").agg(F.sum(F.when(_weight(LANG_WEIGHTS, "lang") > 0, F.col("cap")).otherwise(0.0)).alias("cap"))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    doms = fill(doms.withColumn("budget", F.lit(float(total))).withColumn("weight", _weight(DOMAIN_WEIGHTS, "domain")).withColumn("all", F.lit(1)), ["all"], ["domain"])
    langs = langs.join(doms.select(F.col("domain").alias("d"), F.col("got").alias("budget")), F.col("domain").eqNullSafe(F.col("d"))).drop("d")
    langs = fill(langs.withColumn("weight", _weight(LANG_WEIGHTS, "lang")), ["domain"], ["lang"])
    up = langs.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("got").alias("budget"))
    out = x.join(up, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).withColumn("weight", F.lit(1.0))
    return fill(out, L[:2], ["source"]).select(*L, "tokens", F.round("got").cast("long").alias("budget"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents chosen; copies is 1 or more.

    Each leaf (domain, language, source) gets a token budget (see leaf_budgets) and takes whole epochs as far as it
    goes, then a prefix of one more epoch, in the order of md5(seed:epoch:doc_id): documents that begin before the
    budget is reached. Prefix sums run over buckets of that order, so a leaf with a third of all rows is many window
    partitions. Tokens are words. Documents without words (null or empty text) cost nothing and are chosen when the
    prefix reaches them; a null language, source or id is a value of its own; rows repeated with one id tie and stand
    by token count; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(domain_of(F.col(source_col)), F.lit(DOMAINS[0])).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    rows, L = materialise(rows, "tokens"), ["domain", "lang", "source"]
    leaves = materialise(rows.groupBy(*L).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    budgets = materialise(leaf_budgets(leaves.drop("rows"), share, max_epochs).join(leaves.select(*L, "rows").hint("merge"), L), "budgets")
    plan = budgets.select(
        *L, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"),
    )
    x = rows.join(sized(plan, 100_000), L)
    x = x.withColumn("o", F.md5(F.concat(F.lit(f"{seed}:"), "whole", F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    x = x.withColumn("bucket", F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)).cast("long"))
    x = materialise(x, "ordered")
    sums = x.groupBy(*L, "bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy(*L).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select(*L, "bucket", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("ahead")), "sums")
    within = Window.partitionBy(*L, "bucket").orderBy("o", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(sized(sums, 100_000), [*L, "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    x = x.withColumn("copies", F.col("whole") + (F.col("start") < F.col("rest")).cast("long"))
    return x.where("copies > 0").select("doc_id", *L, "n_tokens", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(table: dict[str, float], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {w}::DOUBLE" for k, w in table.items()) + " ELSE 1.0::DOUBLE END"


def _fill_sql(source: str, parent: str, order: str) -> str:
    return f"""SELECT *, CASE WHEN isfull THEN cap ELSE weight * max(CASE WHEN NOT isfull THEN {{'w': ww, 'b': b}} END) OVER (PARTITION BY {parent}).b
   / max(CASE WHEN NOT isfull THEN {{'w': ww, 'b': b}} END) OVER (PARTITION BY {parent}).w END AS got
 FROM (SELECT *, cap * ww <= weight * b AS isfull FROM (SELECT *,
   budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b,
   sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww FROM ({source})))"""


ORACLE = rf"""
WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  list_extract({list(DOMAINS)!r}, CAST(coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4 AS INT) + 1) AS domain FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap FROM r GROUP BY ALL),
langs0 AS (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL),
doms0 AS (SELECT domain, sum(cap) AS cap, {_case(DOMAIN_WEIGHTS, 'domain')} AS weight, (SELECT sum(tokens) * {SHARE}::DOUBLE FROM leaves) AS budget FROM langs0 GROUP BY domain),
doms AS ({_fill_sql('SELECT * FROM doms0', '1', 'domain')}),
langs AS ({_fill_sql(f"SELECT a.domain, a.lang, a.cap, {_case(LANG_WEIGHTS, 'a.lang')} AS weight, d.got AS budget FROM langs0 a JOIN doms d USING (domain)", 'domain', 'lang')}),
lv AS ({_fill_sql('SELECT a.*, 1.0::DOUBLE AS weight, l.got AS budget FROM leaves a JOIN langs l USING (domain, lang)', 'domain, lang', 'source')}),
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(round(got) AS BIGINT) // tokens ELSE 0 END AS whole,
  CASE WHEN tokens > 0 THEN CAST(round(got) AS BIGINT) % tokens ELSE 0 END AS rest FROM lv),
x AS (SELECT r.*, p.whole, p.rest, md5(concat('{SEED}:', p.whole, ':', r.doc_id)) AS o FROM r JOIN p USING (domain, lang, source)),
y AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM y WHERE whole + CASE WHEN start < rest THEN 1 ELSE 0 END > 0
"""
