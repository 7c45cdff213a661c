"""Operator 13: runs of periodic text by a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import CRC_SQL, WORD, crc_sql

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
#: Words, over several texts, that are worked on at once.
BATCH_WORDS = 1 << 17


def _sorted(high: np.ndarray, low: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by (high, low, position), and where a new pair begins. All values are n at most."""
    if n < 1 << 20:  # three numbers fit in one long
        key = np.sort((high * (n + 1) + low) * (n + 1) + at)
        pair = key // (n + 1)
        return key - pair * (n + 1), np.r_[True, pair[1:] != pair[:-1]]
    order = np.lexsort((at, low, high))
    h, w = high[order], low[order]
    return at[order], np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]


def runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of codes, in rows. longest: of the texts in it, which codes that occur
    once must keep apart. No code is over the sequence's length.

    Level l names the factors of l words, l being a power of two, by the pair of names of their halves. Only factors that
    occur again are kept. Occurrences whose both ends lie within 2 l words follow each other at one distance as long as
    the text is periodic: each such progression with a difference over l / 2 proposes a period. Its factors cover exactly
    the words that repeat at that distance, so it is as long as the run, and as l is at least the period, no smaller one
    divides it. Each run has a progression at one level only: the distance is at most l, and a run of three periods holds
    a factor of l words and its successor.
    """
    n, found = len(codes), []
    at, high, low, size = np.arange(n), codes, np.zeros(n, np.int64), 1
    while len(at) and TIMES * (size // 2 + 1) <= longest:
        order, new = _sorted(high, low, at, n)
        gap = np.zeros(n, np.int64)
        gap[order[:-1]] = np.where(new[1:], 0, order[1:] - order[:-1])
        here = np.flatnonzero((gap > size // 2) & (gap <= size))
        if len(here):
            first = np.flatnonzero(np.r_[True, (here[1:] != here[:-1] + 1) | (gap[here[1:]] != gap[here[:-1]])])
            start, period = here[first], gap[here[first]]
            length = np.diff(np.r_[first, len(here)]) + size - 1 + period
            ok = length >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack((start[ok], length[ok], period[ok]), axis=1))
        name = np.cumsum(new) - 1
        again = np.bincount(name)[name] > 1
        names = np.full(n + size, -1)
        names[order[again]] = name[again]
        at = np.flatnonzero(names[:n] >= 0)
        at = at[names[at + size] >= 0]
        high, low = names[at], names[at + size]
        size *= 2
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return np.unique(every, axis=0)  # by start, then length and period


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each of several lists of words, by start, then period."""
    words = [w for t in texts for w in (*t, b" ")]  # no word is a space
    ids = dict(zip(dict.fromkeys(words), count()))
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes[ends - 1] = len(ids) + np.arange(len(texts))  # a border of its own behind every text
    found = runs(codes, max(map(len, texts)))
    owner = np.searchsorted(ends, found[:, 0], side="right")
    found[:, 0] -= np.r_[0, ends][owner]
    found = found[np.lexsort((found[:, 2], found[:, 0], owner))]
    cuts = np.searchsorted(np.sort(owner), np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by spaces."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join(w for w, drop in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not drop)


_RUN = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def put(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts)
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
        flat = np.concatenate(found)
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"]))
        kept = pa.array([collapse(t, f) for t, f in zip(texts, found, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists.cast(_RUN_TYPE), kept], names=["doc_id", "runs", "kept"])

    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = text.as_py().split()  # bytes: at ASCII white space only
            ids.append(doc_id)
            texts.append(words)
            size += len(words) + 1
            if size >= BATCH_WORDS:
                yield put(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield put(ids, texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, kept) for every row: the maximal runs of periodic text, and the text with each run cut to its first period.

    A run is a stretch of at least LEAST words and TIMES its smallest period that no neighbouring word extends; runs stand
    by start, then period, and are judged on the whole text. A word goes if any run has it after its first period; kept
    words are joined by single spaces. Each row is judged alone, in its task: nothing is shuffled, and a text's working
    set is a few longs a word. Null and empty texts have no runs; null ids and repeated rows stay; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(_periods, f"doc_id long, runs {_RUN}, kept binary").withColumn("kept", F.col("kept").cast("string"))


def looped(doc_id: Column, text: Column) -> Column:
    """The contract's damage: in a tenth of the documents, all words from one on repeat the words from there to the next. A null id counts as the empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(turns, 1, n - a)), " ")

    # the lambda's variable is the words, split once
    once = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), again), 1)
    return F.when((h % 10 == 0) & text.rlike(WORD), once).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    # of two fractions with terms below 2^26, equal ones are equal doubles and others are not
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = rf"""
WITH RECURSIVE {CRC_SQL}
 d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crc_),
 d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
 d2 AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d1),
 d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1] FOR i IN range(n)] ELSE w END AS w FROM d2),
 f AS (SELECT doc_id, n, i, hash(list_slice(w, i + 1, i + 8)) AS fh, array_to_string(list_slice(w, i + 1, i + 8), ' ') AS f FROM d, unnest(range(n - 7)) AS r(i)),
 eq AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM f AS x JOIN f AS y ON x.doc_id = y.doc_id AND x.fh = y.fh AND x.f = y.f AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
 islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq),
 every AS (SELECT doc_id, min(i) AS start, count(*) + 7 + q AS length, q AS period FROM islands GROUP BY doc_id, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
 runs AS (SELECT doc_id, start, length, min(period) AS period FROM every GROUP BY ALL),
 agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, arg_min({{'s': start, 'l': length, 'p': period}}, {{'x': -length / period, 's': start, 'p': period}}) AS b FROM runs GROUP BY doc_id),
 gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS r(i)),
 kept AS (SELECT d.doc_id, string_agg(w[r.i + 1], ' ' ORDER BY r.i) FILTER (WHERE gone.i IS NULL) AS t FROM d, unnest(range(n)) AS r(i) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = r.i GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
