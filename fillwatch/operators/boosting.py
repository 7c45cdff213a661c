"""Boosted regression trees by histograms: one aggregate of gradient sums per level, leaves with L2, columns and rows drawn per tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.session import stored

#: Trees after which the training rows' predictions are written anew.
KEEP_EVERY = 10


@dataclass
class Tree:
    """Nodes as a heap: feature to split on (-1: leaf), the last bin that goes left, and the value added to predictions."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """Where each row ends, by its bins."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (on := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            at = np.where(on, 2 * at + 1 + (bins[rows, f] > self.cut[at]), at)
        return at


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None
    output: str = "predicted_hours"

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """A row's bin of each feature: how many edges lie below the value. What is missing is in the first bin."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="left") for e, c in zip(self.edges, columns, strict=True)], axis=1).astype(np.uint8)

    def predict(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            out += t.value[t.node(bins)]
        return out if trees is not None else out + self.base

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the predictions, as a model of Spark ML would give them."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series(self.predict(self.bins([x[c].to_numpy(float, na_value=np.nan) for c in x])))

        columns = F.struct(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(self.features)])
        return df.withColumn(self.output, F.pandas_udf(run, "double")(columns))

    @property
    def importance(self) -> list[float]:
        """Each feature's share of all gains."""
        total = self.gains.sum()
        return (self.gains / total if total > 0 else self.gains).tolist()


def drawn(key: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree learns from: the same for a row whichever task it is in."""
    h = key.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return (h >> np.uint64(40)) < share * (1 << 24)


def best_split(g: np.ndarray, n: np.ndarray, l2: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's sums by feature and bin; ties go to the first. Without a gain the feature is -1."""
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    right_g, right_n = all_g - left_g, all_n - left_n
    gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - all_g**2 / (all_n + l2)
    gain = np.where((left_n >= least) & (right_n >= least), gain, 0.0)
    k = int(np.argmax(gain))
    f, b = divmod(k, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-12 else (0.0, -1, 0)


def _packed(df: DataFrame, model: Boosted, label: str) -> DataFrame:
    """Training rows as (bins: one byte a feature, y, p: prediction so far, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.bins([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[2:]])
            cols = [pa.array([r.tobytes() for r in x], pa.binary()), b.column(0), pa.array(np.full(len(x), model.base)), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, names=["bins", "y", "p", "key"])

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.xxhash64(*model.features, label).alias("key"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(model.features)])
    return stored(rows.mapInArrow(run, "bins binary, y double, p double, key long"), "binned")


def _unpacked(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, width)


def _sums(rows: DataFrame, model: Boosted, new: list[Tree], tree: Tree, level: int, columns: np.ndarray, number: int, share: float, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and counts by node of a level, drawn feature and bin. Each task hands on one row a sum."""
    first, nodes, n = (1 << level) - 1, 1 << level, len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = nodes * len(columns) * width
        g, c = np.zeros(size), np.zeros(size)
        for b in batches:
            x = _unpacked(b, n)
            at = tree.node(x) - first
            use = (at >= 0) & drawn(b.column(3).to_numpy(), number, share, seed)
            grad = b.column(2).to_numpy() + model.predict(x, new) - b.column(1).to_numpy()
            slot = ((at[:, None] * len(columns) + np.arange(len(columns))) * width + x[:, columns])[use].ravel()
            g += np.bincount(slot, np.repeat(grad[use], len(columns)), size)
            c += np.bincount(slot, minlength=size)
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(c[some])], names=["slot", "g", "n"])

    got = rows.mapInArrow(run, "slot long, g double, n double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()  # nodes x features x bins at most
    g, c = np.zeros(nodes * len(columns) * width), np.zeros(nodes * len(columns) * width)
    g[got.slot], c[got.slot] = got.g, got.n
    return g.reshape(nodes, len(columns), width), c.reshape(nodes, len(columns), width)


def fit_boosted(train: DataFrame, features: list[str], label: str, rounds: int = 200, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, l2: float = 1.0, least: float = 1.0, bins: int = 64, seed: int = 42, edges: list[list[float]] | None = None) -> Boosted:
    """Trees on squared error, each fitted to what the ones before leave.

    Features are cut into at most `bins` bins at approximate quantiles (or at `edges`, ascending). The rows are written
    once as a byte a feature; each level of a tree is one pass over them that sums gradients and counts by node, feature
    and bin within the tasks, and the driver gets those sums alone: their number depends on the model's size, not on the
    rows'. A leaf's value is the shrunken mean of what is left, with l2. Rows without a label are left out, missing features
    are in the first bin; without rows the model predicts 0.
    """
    known = stored(train.where(F.col(label).isNotNull()).select(label, *features), "train")
    if edges is None:
        edges = known.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, [k / bins for k in range(1, bins)], 1 / (4 * bins))
    model = Boosted(features, [np.unique(np.array(e, float)) for e in edges], gains=np.zeros(len(features)))
    model.base = float(known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    width = max(len(e) for e in model.edges) + 1
    data, new, rng = _packed(known, model, label), [], np.random.default_rng(seed)
    for number in range(rounds):
        use = np.sort(rng.choice(len(features), max(1, round(columns * len(features))), replace=False))
        tree = Tree.of_depth(depth)
        for level in range(depth + 1):
            g, n = _sums(data, model, new, tree, level, use, number, rows, seed, width)
            first = (1 << level) - 1
            for k in np.flatnonzero(n[:, 0].sum(axis=1)):
                tree.value[first + k] = -rate * g[k, 0].sum() / (n[k, 0].sum() + l2)
                gain, f, cut = best_split(g[k], n[k], l2, least) if level < depth else (0.0, -1, 0)
                if f >= 0:
                    tree.feature[first + k], tree.cut[first + k] = use[f], cut
                    model.gains[use[f]] += gain
            if not (tree.feature[first : first + (1 << level)] >= 0).any():
                break
        model.trees.append(tree)
        new.append(tree)
        if len(new) == KEEP_EVERY and number + 1 < rounds:
            data, new = stored(_advanced(data, model, new), "binned"), []
    return model


def _advanced(data: DataFrame, model: Boosted, new: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array(b.column(2).to_numpy() + model.predict(_unpacked(b, len(model.features)), new))
            yield b.set_column(2, "p", p)

    return data.mapInArrow(run, data.schema)
