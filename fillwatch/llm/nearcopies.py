"""Operator 6 by similarity: balls of SimHash fingerprints first, MinHash bands for what lies beyond two bits, every pair verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwatch.llm.common import components, materialise, sized
from fillwatch.llm.simhash import BITS
from fillwatch.llm.simhash import links as ball_links
from fillwatch.llm.substrings import Hashes, mix

#: Words of a shingle; similarity of a near copy, 4 / 5; bands and rows of the signature: a pair at 0.8 shares none with a chance of 1.2e-7.
SHINGLE, PART, WHOLE, BANDS, ROWS = 5, 4, 5, 40, 5

#: Members, and shingles, of a bucket that one task compares with each other or with as many more.
TILE, TILE_SHINGLES = 128, 1 << 20

_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_C = _RNG.integers(0, 1 << 63, ROWS + 1, np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; texts shorter than a shingle hash whole, those without words have none."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    h = Hashes(np.frombuffer(b" ".join(words), np.uint8))
    return np.unique(h.of(np.r_[0, ends + 1][:n], ends[min(SHINGLE, len(words)) - 1 :]))


def bands(h: np.ndarray) -> np.ndarray:
    """One hash a band of the least values of the shingles under BANDS * ROWS permutations."""
    low, x = np.full(len(_A), (1 << 32) - 1, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(low, (_A * x[k : k + 512] + _B).min(axis=1), out=low)
    return mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _C[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _C[ROWS])


def fingerprint(h: np.ndarray) -> int:
    """Majority bits over distinct shingles, as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both) > 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the hash of their set of shingles, its fingerprint and bands, all null for texts without words."""
    for batch in batches:
        keys, fps, sigs = [], [], []
        for t in batch.column(batch.num_columns - 1):
            h = shingles(t.as_py())
            keys.append(int(mix((mix(h).sum() + np.uint64(len(h)))[None]).view(np.int64)[0]) if len(h) else None)
            fps.append(fingerprint(h) if len(h) else None)
            sigs.append(bands(h).view(np.int64) if len(h) else None)
        cols = [*batch.columns[:-1], pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "_key", "_fp", "_bands"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verify(pairs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) of keys whose texts are near copies."""
    wanted = pairs.select(F.col("a").alias("_key")).union(pairs.select("b")).distinct()
    texts = materialise(rows.join(sized(wanted), "_key", "left_semi").groupBy("_key").agg(F.min(text_col).cast("binary").alias("t")), "texts")
    both = pairs.hint("merge").join(texts.select(F.col("_key").alias("a"), F.col("t").alias("ta")), "a")
    both = both.hint("merge").join(texts.select(F.col("_key").alias("b"), F.col("t").alias("tb")), "b")
    return materialise(both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long"), "verified")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """How many elements each set of a shares with each of b: products of 0/1 matrices, `width` distinct elements at a time."""
    sizes = [len(x) for x in (*a, *b)]
    value, row = np.concatenate([*a, *b]), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(value, kind="stable")
    column = np.cumsum(np.r_[0, value[order][1:] != value[order][:-1]])
    out = np.zeros((len(a), len(b)))
    for k in range(0, int(column[-1]) + 1, width):
        part = slice(*np.searchsorted(column, (k, k + width)))
        x = np.zeros((len(sizes), width), np.float32)
        x[row[order][part], column[part] - k] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near copies between two tiles of a bucket (or within one), as stars on the least key of each local component."""
    i, j = pdf.i.iloc[0], pdf.j.iloc[0]
    left, right = pdf[pdf["sub"] == i], pdf[pdf["sub"] == j]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    a, b = ([np.asarray(h, np.int64) for h in x.h] for x in (left, right))
    both = overlaps(a, b)
    u, v = np.nonzero(WHOLE * both >= PART * (np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both))
    ids, at = np.unique(np.r_[left.k.to_numpy(np.int64), right.k.to_numpy(np.int64)], return_inverse=True)
    u, v, low = at[u], at[len(a) + v], np.arange(len(ids))
    while len(u):
        was = low.copy()
        np.minimum.at(low, u, low[v])
        np.minimum.at(low, v, low[u])
        if (was == low).all():
            break
    linked = np.flatnonzero(low != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[low[linked]], "b": ids[linked]})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            h = shingles(t.as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([h], pa.list_(pa.int64()))], names=["k", "n", "h"])


def within_buckets(placed: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """Links (a, b) that give the components of all near copies among the members (band, k) of each bucket.

    Buckets are cut into tiles, and each pair of tiles is compared in one task: no pair of members is ever a row.
    """
    wanted = placed.select(F.col("k").alias("_key")).distinct()
    texts = rows.join(sized(wanted), "_key", "left_semi").groupBy("_key").agg(F.min(text_col).cast("binary").alias("t"))
    sets = materialise(texts.mapInArrow(_sets, "k long, n long, h array<long>"), "sets")
    weighed = placed.select("band", "k").hint("merge").join(sets.select("k", "n"), "k")
    subs = weighed.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("subs"))
    x = placed.select("band", "k").hint("merge").join(subs, "band").withColumn("sub", F.pmod(F.xxhash64("k"), F.col("subs")).cast("int"))
    x = x.select("band", "k", "sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("other"))
    x = x.select("band", "k", "sub", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"))
    x = x.hint("merge").join(sets.select("k", "h"), "k")
    return materialise(x.groupBy("band", "i", "j").applyInPandas(_tile_links, "a long, b long").distinct(), "within")


def links(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) between keys that give the components of all near copies that share a ball or a band.

    Fingerprints in a common ball are compared first. Of each band's bucket, members that this left apart are compared
    with the least key: a large group of near copies costs one comparison a member and bucket. Buckets that are in several
    components still are compared in full, tile by tile.
    """
    distinct = materialise(rows.where("_key IS NOT NULL").groupBy(F.col("_key").alias("k")).agg(F.first("_fp").alias("fp"), F.first("_bands").alias("x")), "distinct")
    rep = materialise(distinct.groupBy("fp").agg(F.min("k").alias("a")), "reps")
    pairs = ball_links(rep.select("fp")).hint("merge").join(rep.select(F.col("fp").alias("a"), F.col("a").alias("ka")), "a").hint("merge").join(rep.select(F.col("fp").alias("b"), F.col("a").alias("kb")), "b")
    same = distinct.select("fp", F.col("k").alias("b")).hint("merge").join(rep, "fp").where("a <> b").select("a", "b")
    balls = materialise(same.union(pairs.select(F.least("ka", "kb"), F.greatest("ka", "kb"))).distinct(), "balls")
    good = verify(balls, rows, text_col)
    near = materialise(components(good), "near")
    members = distinct.select("k", F.explode("x").alias("band")).hint("merge").join(near, F.col("k") == F.col("node"), "left").select("band", "k", F.coalesce("component", "k").alias("c"))
    members = materialise(members, "members")
    buckets = members.groupBy("band").agg(F.min(F.struct("k", "c")).alias("least"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band", F.col("least.k").alias("a"), F.col("least.c").alias("d"))
    found = materialise(members.hint("merge").join(buckets, "band").select("band", "a", "d", "k", "c"), "buckets")
    stars = materialise(found.where("c <> d").select("a", F.col("k").alias("b")).distinct().hint("merge").join(balls, ["a", "b"], "left_anti"), "stars")
    good = materialise(good.union(verify(stars, rows, text_col)), "good")
    labels = materialise(components(good), "labels")
    placed = found.select("band", "k").hint("merge").join(labels, F.col("k") == F.col("node"), "left").select("band", "k", F.coalesce("component", "k").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    placed = materialise(placed.hint("merge").join(mixed, "band", "left_semi"), "placed")
    return good.union(within_buckets(placed, rows, text_col)) if placed.limit(1).count() else good


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but those that are, over a chain of near copies, linked to a row with a smaller id.

    Near copies share four fifths or more of their distinct 5-word shingles (lower case, words at ASCII white space;
    a text of fewer words is one shingle). Texts without words stay. Rows without an id go if a linked row has one, else
    stay; an empty table gives an empty result.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    rows = materialise(docs.withColumn("_t", F.col(text_col).cast("binary")).mapInArrow(_signed, schema), "signed")
    near = materialise(components(links(rows, text_col)), "near")
    each = materialise(rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "each")
    place = materialise(each.hint("merge").join(near, F.col("_key") == F.col("node"), "left").select("_key", "rep", "n", F.col("node").isNotNull().alias("linked"), F.coalesce("component", "_key").alias("c")).where("linked OR n > 1"), "place")
    fate = place.hint("merge").join(place.groupBy("c").agg(F.min("rep").alias("least")), "c").select("_key", "least")
    fate = materialise(fate, "fate")
    out = rows.join(sized(fate), "_key", "left").where(F.col("least").isNull() | F.col("least").eqNullSafe(F.col(id_col)))
    return out.select(*docs.columns)
