"""Operator 7: toxicity by compression distance between an ordinary and a toxic zstandard dictionary."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import held_out, materialise

#: Bounds of what the model is fitted on: labelled documents of each kind, windows and pieces for the two dictionaries, strings that tell toxic text.
MAX_TOXIC, MAX_ORDINARY, MAX_WINDOWS, MAX_PIECES, MAX_STRINGS = 2000, 4000, 40_000, 60_000, 200_000
#: Windows stay below the length from which zstandard entropy-codes literals: lengths then differ by matches alone.
WINDOW, BASE_BYTES, TOXIC_BYTES = 60, 12_000, 768
#: Toxic text is what stands so many times likelier in toxic documents, in so many of them at least, by strings of STRING bytes.
STRING, LIFT, LEAST, PIECE = 8, 50.0, 3, 256


@dataclass
class Model:
    """The two dictionaries, the toxic one in front of the ordinary one, and the calibration (bias, weights of max, top three, log n)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows of WINDOW bytes at most, cut at spaces where there are any; lower-cased, spaces single."""
    b, out, i = b" ".join(text.lower().split()), [], 0
    while i < len(b):
        j = min(len(b), i + WINDOW)
        if j < len(b) and (k := b.rfind(b" ", i, j)) > i:
            j = k
        out.append(b[i : j + 1] if j < len(b) and b[j : j + 1] == b" " else b[i:j])
        i += len(out[-1])
    return out


def _compressor(content: bytes) -> zs.ZstdCompressor:
    how = zs.ZstdCompressionParameters(window_log=16, hash_log=14, chain_log=14, search_log=6, min_match=5, strategy=4, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


class Scorer:
    """Window length differences of texts under a model's dictionaries."""

    def __init__(self, model: Model):
        self.a, self.b, self.w = _compressor(model.ordinary).compress, _compressor(model.toxic).compress, model.weights

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Largest difference, sum of the three largest, log of the window count; zeros for texts without words."""
        d = sorted((len(self.a(w)) - len(self.b(w)) for w in windows(text)), reverse=True)
        return (float(d[0]), float(sum(d[:3])), math.log(len(d))) if d else (0.0, 0.0, 0.0)

    def score(self, text: bytes) -> float:
        z = self.w[0] + sum(w * x for w, x in zip(self.w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, y): up to most[y] labelled documents that may be learnt from, chosen by a hash of the id.

    One row an id: of rows repeated with one id the smallest text counts, and the largest label.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).alias("y")).where("y IS NOT NULL")
    chosen = None
    for y, n in most.items():
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most sum(most) ids
    return materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")


def strings(text: bytes) -> np.ndarray:
    """All strings of STRING bytes of a text, lower-cased and with single spaces, as integers; none of shorter texts."""
    b = np.frombuffer(b" ".join(text.lower().split()), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, STRING)).view(np.int64).ravel() if len(b) >= STRING else np.zeros(0, np.int64)


def telling(rows: DataFrame) -> np.ndarray:
    """The strings that stand LIFT times likelier in the sample's toxic documents, the commonest first if there are too many; sorted."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = np.unique(strings(t.as_py()))
                yield pa.record_batch([pa.array(x), pa.array(np.full(len(x), y, np.int32))], names=["x", "y"])

    seen = rows.select(F.col("text").cast("binary").alias("t"), F.col("y").cast("int").alias("y")).mapInArrow(run, "x long, y int")
    counts = seen.groupBy("x").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")).where(F.col("t") >= LEAST)
    more = counts.where((F.col("t") + 0.5) / n[1] >= LIFT * (F.col("o") + 0.5) / n[0])
    return np.sort(np.array([r.x for r in more.orderBy(F.desc("t"), "x").select("x").limit(MAX_STRINGS).collect()], np.int64))


def toxic_pieces(text: bytes, known: np.ndarray) -> list[bytes]:
    """The parts of a text that the known strings cover."""
    b, x = b" ".join(text.lower().split()), strings(text)
    if not len(x) or not len(known):
        return []
    hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    runs = zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + STRING - 1).tolist(), strict=True)
    return [b[i : min(j, i + PIECE)] for a, j in runs for i in range(a, j, PIECE)]


def _chosen(rows: DataFrame, cut: Callable[[bytes], list[bytes]], most: int) -> list[bytes]:
    """Up to so many parts of the texts, chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(cut(t.as_py() or b""), pa.binary())], names=["w"])

    ws = rows.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "w binary")
    return [bytes(r.w) for r in ws.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; of too few for that, their last bytes."""
    try:
        return zs.train_dictionary(size + 4096 if size > 4096 else size + 512, samples, k=k, d=6).as_bytes()[-size:]
    except (zs.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def _fit(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, then the intercept moved so that 0.5 is the threshold of best F1.

    each: how many labelled rows a row of the sample stands for, as toxic ones are sampled more densely.
    """
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (y - p) - 0.1 * w)
        w += np.clip(step, -2, 2)
    z = a @ w
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum((y * each)[order])
    f1 = 2 * hit / (np.cumsum(each[order]) + (y * each).sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # ties fall on one side
    k = int(np.argmax(f1))
    w[0] -= (z[order][k] + (z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1)) / 2
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both dictionaries and the calibration, from a bounded sample of labelled rows that are not held out.

    The ordinary dictionary is trained by zstandard on windows of ordinary documents. Toxic documents are ordinary but
    for a few words, so the toxic one is trained on the parts of them that ordinary documents hardly have (on all their
    windows where there are none), and stands in front of the ordinary one: windows without toxic text compress alike.
    Without toxic or without ordinary labels every score is 0.
    """
    rows = sample(docs, labels, "toxic", {1: MAX_TOXIC, 0: MAX_ORDINARY})
    known = telling(rows)
    base = _trained(_chosen(rows.where("y = 0"), windows, MAX_WINDOWS), BASE_BYTES, 32) or b" "
    pieces = _chosen(rows.where("y = 1"), lambda t: toxic_pieces(t, known), MAX_PIECES) or _chosen(rows.where("y = 1"), windows, MAX_WINDOWS)
    model = Model(base, _trained(pieces, TOXIC_BYTES, 10) + base)
    have = rows.select(F.col("text").cast("binary").alias("t"), "y").mapInArrow(lambda it: _features(it, model), "a double, b double, c double, y int").collect()
    y = np.array([r.y for r in have], float)
    if not 0 < y.sum() < len(y):
        return Model(model.ordinary, model.toxic, (-30.0, 0.0, 0.0, 0.0))
    n = {r.toxic: r["count"] for r in labels.where(~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()}
    each = np.where(y == 1, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum()))
    return Model(model.ordinary, model.toxic, _fit(np.array([r[:3] for r in have], float), y, each))


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        f = np.array([scorer.features(t.as_py() or b"") for t in batch.column(0)], float).reshape(-1, 3)
        yield pa.record_batch([*map(pa.array, f.T), batch.column(1).cast(pa.int32())], names=["a", "b", "c", "y"])


def toxic_score(model: Model, text: Column) -> Column:
    """The score of a text column, for use among other columns of any table."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for part in texts:
            yield pd.Series([scorer.score(t or b"") for t in part], dtype="float64")

    return F.pandas_udf(run, "double")(text.cast("string").cast("binary"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, one narrow pass over the whole texts.

    Null and empty texts have no windows and score as such (far below the threshold). Null ids and repeated rows pass
    through; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            s = pa.array([scorer.score(t.as_py() or b"") for t in batch.column(1)], pa.float64())
            yield pa.record_batch([batch.column(0), s], names=["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
