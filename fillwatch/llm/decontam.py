"""Operator 1: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import materialise, sized
from fillwatch.llm.licenses import word_array

#: A window of WINDOW words leaks if NEEDED of them (0.8) stand at the same relative places in a text.
WINDOW, NEEDED, SHORTEST = 15, 12, 5
#: Offsets that are compared; the others are ignored. Together they miss no window with three substitutions (tested).
MASKS = ((0, 1, 3, 4, 5), (0, 8, 9, 10, 11))
#: For items shorter than a window, which must stand whole and unchanged.
SHORT_MASK = (0, 1, 2, 3, 4)
#: Seeds of the benchmark up to which they are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 1_000_000
#: Words of all items up to which their texts are broadcast.
BROADCAST_ITEM_WORDS = 1_000_000


def seeds(hashes: Column, mask: tuple[int, ...], number: int) -> Column:
    """One hash per start of the mask in an array of word hashes; none where it doesn't fit."""
    span = mask[-1] + 1
    return F.when(F.size(hashes) >= span, F.transform(F.sequence(F.lit(0), F.size(hashes) - span), lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + o) for o in mask]))).otherwise(F.array().cast("array<long>"))


def _seed_rows(words: DataFrame, key: str, masks: list[tuple[int, ...]], numbers: list[int]) -> DataFrame:
    """(key, seed, start) of all masks."""
    hashed = words.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    parts = hashed.select(key, F.size("h").alias("n"), F.concat(*[seeds(F.col("h"), m, k) for m, k in zip(masks, numbers, strict=True)]).alias("s"))
    rows = parts.select(key, "n", F.posexplode_outer("s").alias("at", "seed"))  # outer: else a filter on the hashes is inferred, which makes them twice
    start, before = F.col("at"), F.lit(0)
    for m in masks:  # hashes of the masks stand one after the other
        many = F.greatest(F.lit(0), F.col("n") - m[-1])
        start = F.when((F.col("at") >= before) & (F.col("at") < before + many), F.col("at") - before).otherwise(start)
        before = before + many
    return rows.select(key, "seed", start.alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, best, first_word) of every document that holds a part of a benchmark item.

    Words are compared lower-cased and without punctuation. A part is a window of 15 words of the item of which 12
    or more stand at the same relative places in the document; an item of 5 to 14 words counts if it stands whole;
    shorter items are not looked for. n_windows counts such windows over all alignments, best is the most words that
    agree in one, first_word the smallest place in the document. Seeds find the alignments, the words themselves are
    then compared. Null or empty texts and items hold nothing; rows with a null id on either side are left out; rows
    repeated with one id count as one document with the larger figures; other columns are ignored.
    """
    raw = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = raw.select("doc_id", word_array(F.col("text")).alias("words"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), word_array(F.col(item_text)).alias("words"))
    items = materialise(items.where(F.size("words") >= SHORTEST).distinct(), "items")
    full, short = items.where(F.size("words") >= WINDOW), items.where(F.size("words") < WINDOW)
    any_short = bool(short.limit(1).count())
    masks, numbers = [*MASKS, SHORT_MASK][: 2 + any_short], [0, 1, 2][: 2 + any_short]
    # Items are known by a number of their own: one id may stand for several texts.
    keyed = lambda x: x.withColumn("item", F.xxhash64("item_id", "words"))
    theirs = _seed_rows(keyed(full), "item", list(MASKS), [0, 1]).union(_seed_rows(keyed(short), "item", [SHORT_MASK], [2]).where("start = 0"))
    theirs = materialise(theirs.withColumnRenamed("start", "item_start"), "seeds")
    hits = _seed_rows(words, "doc_id", masks, numbers).join(sized(theirs, BROADCAST_SEEDS), "seed").select("doc_id", "item", (F.col("start") - F.col("item_start")).alias("shift")).distinct()
    hits = materialise(hits, "hits")
    with_items = hits.join(sized(keyed(items), BROADCAST_ITEM_WORDS, F.size("words")).withColumnRenamed("words", "theirs"), "item")
    # Rows repeated with one id: equal texts count once, of different ones the larger figures.
    # The texts with hits are read from their source once more, and only they are split into words again; no copy of the corpus is made.
    few = materialise(raw.join(sized(hits.select("doc_id").distinct()), "doc_id", "left_semi"), "texts")
    texts = few.select("doc_id", word_array(F.col("text")).alias("words")).withColumn("row", F.xxhash64("words"))
    pairs = with_items.hint("merge").join(texts.dropDuplicates(["doc_id", "row"]), "doc_id")
    same = F.transform("theirs", lambda w, j: F.when((F.col("shift") + j >= 0) & (F.get("words", F.col("shift") + j) == w), 1).otherwise(0))
    long = F.least(F.size("theirs"), F.lit(WINDOW))
    pairs = pairs.select("doc_id", "row", "item_id", "shift", long.alias("long"), same.alias("same"))
    counts = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("long")), lambda s: F.struct(F.aggregate(F.slice("same", s + 1, F.col("long")), F.lit(0), lambda a, x: a + x).alias("n"), (F.col("shift") + s).alias("p")))
    good = F.filter(counts, lambda x: x["n"] >= F.when(F.col("long") == WINDOW, NEEDED).otherwise(F.col("long")))
    pairs = pairs.select("doc_id", "row", "item_id", good.alias("good"))
    each = pairs.groupBy("doc_id", "item_id", "row").agg(F.sum(F.size("good")).cast("long").alias("n_windows"), F.max(F.array_max("good.n")).cast("long").alias("best"), F.greatest(F.lit(0), F.min(F.array_min("good.p"))).cast("long").alias("first_word")).where("n_windows > 0")
    return each.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("best").alias("best"), F.min("first_word").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH d0 AS (SELECT doc_id, {_SPLIT} AS w FROM documents), i0 AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, least(len(w), {WINDOW}) AS long, CASE WHEN len(w) >= {WINDOW} THEN {NEEDED} ELSE len(w) END AS need, j - 1 AS j, w[j] AS w FROM i0, unnest(range(1, len(w) + 1)) AS t(j) WHERE len(w) >= {SHORTEST}),
d AS (SELECT doc_id, p - 1 AS p, w[p] AS w FROM d0, unnest(range(1, len(w) + 1)) AS t(p)),
m AS (SELECT doc_id, item_id, p - j AS shift, list(j) AS js, any_value(n) AS n, any_value(long) AS long, any_value(need) AS need FROM d JOIN i USING (w) GROUP BY ALL HAVING count(*) >= any_value(need)),
x AS (SELECT doc_id, item_id, shift + s AS p, len(list_filter(js, lambda k: k >= s AND k < s + long)) AS c, need FROM m, unnest(range(0, n - long + 1)) AS t(s))
SELECT doc_id, item_id, count(*) AS n_windows, CAST(max(c) AS BIGINT) AS best, CAST(greatest(0, min(p)) AS BIGINT) AS first_word FROM x WHERE c >= need GROUP BY doc_id, item_id
"""
