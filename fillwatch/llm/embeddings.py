"""Operator 3: near-duplicate embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import components, materialise, sized

#: Cosine of a link; vectors of a tile, tiles of a block; pivots at most (any pivots give the same links, more of them prune better).
THRESHOLD, TILE, BLOCK, PIVOTS = 0.93, 1024, 8, 256


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1. They are scaled by powers of two first, which is exact, so that no norm overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, and the norm of what quantisation changed in each row."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j within one tile) with cosine of the unit rows >= threshold, in double precision.

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, so pairs whose int8 product plus this bound stays below the
    threshold can't reach it; the others are computed again from the full vectors, a chunk at a time.
    """
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers below 2**24 are exact
    rough = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    maybe = rough + ea[:, None] + (1 + ea)[:, None] * eb[None, :] >= threshold - 1e-9
    i, j = np.nonzero(np.triu(maybe, 1) if same else maybe)
    sure = np.zeros(len(i), bool)
    for k in range(0, len(i), chunk):
        s = slice(k, k + chunk)
        sure[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return i[sure], j[sure]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a tile: its arrays as bytes, and the range of its angles to the cell's pivot."""
    out, x = io.BytesIO(), np.stack(pdf.e.to_numpy()).astype(np.float64)
    np.savez(out, rep=pdf.rep.to_numpy(np.int64), n=pdf.n.to_numpy(np.int64), x=x)
    row = pdf.iloc[0]
    cell = f"{row.label}/{row.dim}/{row.cell}"
    return pd.DataFrame({"label": [row.label], "dim": [row.dim], "cell": [row.cell], "tile": [f"{cell}/{row['sub']}"], "block": [f"{cell}/{row['sub'] // BLOCK}"], "lo": [pdf.angle.min()], "hi": [pdf.angle.max()], "blob": [out.getvalue()]})


def _links(a: tuple, b: tuple, same: bool, threshold: float) -> pd.DataFrame:
    """Links of one pair of tiles: weighted counts by vector, and a star on the smallest id of each local component."""
    (ra, na, xa), (rb, nb, xb) = a, b
    i, j = close_pairs(xa, xb, threshold, same)
    ids = ra if same else np.r_[ra, rb]
    u, v = i, j + (0 if same else len(ra))
    links = np.bincount(u, nb[j], len(ids)) + np.bincount(v, na[i], len(ids))
    low = ids.copy()
    while len(u):
        was = low.copy()
        np.minimum.at(low, u, low[v])
        np.minimum.at(low, v, low[u])
        if (was == low).all():
            break
    linked = np.flatnonzero(links)
    return pd.DataFrame({"rep": ids[linked], "links": links[linked].astype(np.int64), "anchor": low[linked]})


def _compare(threshold: float):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the tile pairs of one pair of blocks: two blocks of tiles at most are in memory."""
        tiles = {}
        for name, blob in zip(pdf.tile, pdf.blob, strict=True):
            t = np.load(io.BytesIO(bytes(blob)))
            tiles[name] = t["rep"], t["n"], unit_rows(t["x"])
        found = [_links(tiles[a], tiles[b], a == b, threshold) for a, partners in zip(pdf.tile, pdf.partners, strict=True) for b in partners]
        return pd.concat(found) if found else pd.DataFrame({"rep": [], "links": [], "anchor": []}).astype("int64")

    return run


def tiles_of(distinct: DataFrame, pivots: dict[int, np.ndarray], tile: int = TILE) -> DataFrame:
    """Packed tiles of up to about `tile` vectors with equal label and dimension and the same nearest pivot."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, angle = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            dims = pdf.e.map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack(pdf.e.iloc[at].to_numpy()).astype(np.float64)
                cos = unit_rows(x) @ pivots[d].T if d in pivots else np.ones((len(at), 1))
                cell[at], angle[at] = cos.argmax(axis=1), np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pdf.assign(dim=dims, cell=cell, angle=angle)

    rows = materialise(distinct.mapInPandas(cells, "label string, e array<double>, rep long, n long, dim int, cell int, angle double"), "cells")
    counts = materialise(rows.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("subs")), "counts")
    rows = rows.join(sized(counts, 50_000), ["label", "dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs"))).drop("subs")
    return materialise(rows.groupBy("label", "dim", "cell", "sub").applyInPandas(_pack, "label string, dim int, cell int, tile string, block string, lo double, hi double, blob binary"), "tiles")


def tile_pairs(tiles: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(tile, pair, partners) of the tile pairs that can hold a link, by the triangle inequality for angles.

    Two vectors at angles in [lo, hi] to their pivots are at least angle(pivots) - hi - hi' apart, and within one
    cell at least lo' - hi. A tile is compared with itself and each later tile of its label that may be near enough.
    pair is a pair of blocks: tiles travel once for all comparisons of their blocks. partners are those that a tile is
    compared with there.
    """
    spark, near = tiles.sparkSession, float(np.arccos(threshold)) + 1e-6
    apart = [(d, i, j, float(np.arccos(np.clip(p[i] @ p[j], -1, 1)))) for d, p in pivots.items() for i in range(len(p)) for j in range(len(p))]
    apart = spark.createDataFrame(apart, "dim int, cell int, cell2 int, apart double")  # pivots squared at most
    a = tiles.select("label", "dim", "cell", "tile", "block", "lo", "hi")
    b = a.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("cell", "tile", "block", "lo", "hi")])
    both = a.hint("merge").join(b, ["label", "dim"]).where("tile <= tile2").join(F.broadcast(apart), ["dim", "cell", "cell2"], "left")
    far = F.when(F.col("cell") == F.col("cell2"), F.greatest(F.col("lo"), F.col("lo2")) - F.least(F.col("hi"), F.col("hi2"))).otherwise(F.coalesce("apart", F.lit(0.0)) - F.col("hi") - F.col("hi2"))
    pairs = materialise(both.where(far <= near).select("tile", "tile2", F.concat_ws("+", F.least("block", "block2"), F.greatest("block", "block2")).alias("pair")), "pairs")
    none = F.lit(None).cast("string")
    rows = pairs.select("tile", "pair", "tile2").union(pairs.where("tile <> tile2").select("tile2", "pair", none)).groupBy("tile", "pair").agg(F.collect_list("tile2").alias("partners"))
    return materialise(rows, "sides")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links need equal labels and cosine >= threshold.

    Equal vectors of a label are grouped first: one representative (their smallest id) is compared, with the group's
    size as its weight, so copies are never paired with each other. Null labels, null, empty or zero vectors and those
    with null or non-finite components link with nothing, nor do rows with a null id (component null, kept false);
    rows repeated with one id are copies of each other; vectors of different lengths never link; other columns are
    ignored; an empty table gives an empty result. Labels may be of any type that casts to text.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0))
    distinct = materialise(fine.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    # As many pivots as make cells of about a tile, within a bound; any pivots give the same links.
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    taken = distinct.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(PIVOTS, size.n // (tile * max(1, size.labels))))).collect()
    pivots = {d: unit_rows(np.array([r.e for r in taken if len(r.e) == d])) for d in {len(r.e) for r in taken}}
    tiles = tiles_of(distinct, pivots, tile)
    sides = tiles.select("tile", "blob").hint("merge").join(tile_pairs(tiles, pivots, threshold), "tile")
    part = materialise(sides.groupBy("pair").applyInPandas(_compare(threshold), "rep long, links long, anchor long"), "links")
    linked = materialise(components(part.select(F.col("rep").alias("a"), F.col("anchor").alias("b"))), "linked")
    total = materialise(part.groupBy("rep").agg(F.sum("links").alias("links")), "totals")
    known = distinct.hint("merge").join(total, "rep", "left").join(linked.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    known = materialise(known.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    out = keyed.hint("merge").join(known.withColumnsRenamed({"label": "key"}), ["key", "e"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS m FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a WHERE l.b > r.m),
c AS (SELECT a, min(m) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
