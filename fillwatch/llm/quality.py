"""Operator 2: quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import held_out
from fillwatch.llm.toxicity import sample

#: Bounds of the labelled sample by label, hash dimensions, FTRL parameters, shards whose models are averaged each epoch.
MOST, BITS = {0: 4000, 1: 8000}, 18
ALPHA, BETA, L1, L2, EPOCHS, SHARDS = 0.3, 1.0, 0.02, 0.5, 3, 4
THRESHOLD, SCALE = 0.3, 8.0

_CLASS = np.zeros(256, np.uint64)
_CLASS[:] = 3  # bytes beyond ASCII count as small letters, as most are
_CLASS[0:128] = 5
for _c in range(128):
    if chr(_c).isdigit():
        _CLASS[_c] = 1
    elif chr(_c).isupper():
        _CLASS[_c] = 2
    elif chr(_c).islower():
        _CLASS[_c] = 3
    elif _c > 32:
        _CLASS[_c] = 16 + _c
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    return h ^ (h >> np.uint64(29))


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the texts, one text after the other, and how many each text has.

    Words stand twice: by their letters (unigrams, bigrams) and by their shape - character classes with runs
    collapsed, and whether a word repeats the one before (unigrams to trigrams). All in array operations.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_ends, starts, side="right")
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    place = np.arange(len(buf), dtype=np.uint64)
    at = place - np.repeat(place[starts], np.diff(np.r_[starts, len(buf)])) if starts[0] == 0 else place - np.r_[place[: starts[0]], np.repeat(place[starts], np.diff(np.r_[starts, len(buf)]))]
    low = buf + np.where((buf > 64) & (buf < 91), 32, 0).astype(np.uint8)
    letter = np.where(space, np.uint64(0), _mix((low.astype(np.uint64) + np.uint64(1)) * _B + at * _A))
    word = _mix(np.add.reduceat(letter, starts))
    kind = np.where(space, np.uint64(0), _CLASS[buf])
    turn = ~space & np.r_[True, kind[1:] != kind[:-1]]
    turn[starts] = True
    order = np.cumsum(turn).astype(np.uint64)
    order -= np.repeat(order[starts], np.diff(np.r_[starts, len(buf)])) if starts[0] == 0 else np.r_[order[: starts[0]], np.repeat(order[starts], np.diff(np.r_[starts, len(buf)]))]
    shape = np.add.reduceat(np.where(turn, _mix(kind * _B + np.minimum(order, np.uint64(6)) * _A), np.uint64(0)), starts)
    first = np.r_[True, doc[1:] != doc[:-1]]
    shape = _mix(shape + np.where(~first & (word == np.r_[np.uint64(0), word[:-1]]), _B, np.uint64(0)))
    back = lambda h, k: np.where(np.arange(len(h)) - k >= np.r_[0, np.cumsum(n)][doc], np.r_[np.zeros(k, np.uint64), h][: len(h)], np.uint64(k))
    s1, s2 = back(shape, 1), back(shape, 2)
    kinds = [word, word * _A + back(word, 1), shape * _B, (shape * _B + s1) * _A, ((shape * _A + s1) * _B + s2) * _A]
    h = np.stack([_mix(x + np.uint64(i)) >> np.uint64(64 - BITS) for i, x in enumerate(kinds)], axis=1)
    return h.astype(np.int64).ravel(), n * len(kinds)


def vectors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors: buckets and their shares of a text's n-grams, times SCALE."""
    h, n = ngrams(texts)
    out = []
    for part in np.split(h, np.cumsum(n)[:-1]):
        idx, cnt = np.unique(part, return_counts=True)
        out.append((idx, cnt * (SCALE / max(1, len(part)))))
    return out


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss; the bias is bucket 2**BITS."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = (1 << BITS) + 1
        self.z, self.n = (np.zeros(size) if z is None else z), (np.zeros(size) if n is None else n)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def update(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        idx, val = np.r_[idx, 1 << BITS], np.r_[val, 1.0]
        w = self.weights(idx)
        g = (1 / (1 + np.exp(-np.clip(w @ val, -30, 30))) - y) * val
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[idx] = n + g * g


def _shard_run(state: Broadcast, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """FTRL over one shard (a bounded part of the bounded sample), from the state before; every other epoch backwards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(*(x.copy() for x in state.value))
        pdf = pdf.sort_values("o", ascending=epoch % 2 == 0, kind="stable")
        for k in range(0, len(pdf), 256):
            part = pdf.iloc[k : k + 256]
            for (idx, val), y in zip(vectors([bytes(t) for t in part.t]), part.y, strict=True):
                model.update(idx, val, y)
        used = np.flatnonzero(model.n)
        return pd.DataFrame({"i": used, "z": model.z[used], "n": model.n[used]})

    return run


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from a bounded sample of labelled rows that are not held out.

    Each epoch, every shard of the sample runs FTRL over its rows on an executor, from the state of the last epoch;
    the states (two arrays of fixed size a shard) are averaged. Without rows of both labels, all weights are 0.
    """
    rows = sample(docs, labels, "quality", MOST).select(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(1)).alias("o"), F.col("text").cast("binary").alias("t"), F.col("y").cast("int").alias("y"))
    if rows.select("y").distinct().count() < 2:
        return np.zeros((1 << BITS) + 1)
    z = n = np.zeros((1 << BITS) + 1)
    spark = docs.sparkSession
    for epoch in range(EPOCHS):
        run = _shard_run(spark.sparkContext.broadcast((z, n)), epoch)
        got = rows.groupBy("shard").applyInPandas(run, "i long, z double, n double").groupBy("i").agg((F.sum("z") / SHARDS).alias("z"), (F.sum("n") / SHARDS).alias("n")).toPandas()
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        z[got.i], n[got.i] = got.z, got.n
    return Ftrl(z, n).weights(slice(None))


def classify(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: sparse dot products, one narrow pass over the whole texts.

    Null and empty texts have no n-grams and get the score of the bias alone. Null ids and repeated rows pass through;
    other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts, scores, k = [t.as_py() or b"" for t in batch.column(1)], [], 0
            while k < len(texts):  # about 2 MB at a time
                j, size = k, 0
                while j < len(texts) and (j == k or size + len(texts[j]) <= 2_000_000):
                    size, j = size + len(texts[j]), j + 1
                h, n = ngrams(texts[k:j])
                total = np.r_[0.0, np.cumsum(w[h])]
                ends = np.cumsum(n)
                z = (total[ends] - total[ends - n]) * SCALE / np.maximum(n, 1) + w[-1]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                k = j
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
