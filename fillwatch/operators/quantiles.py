"""Exact quantiles of columns too long for one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of a bracket that the driver looks at, and the accuracy of the sketches that find brackets.
FEW, ACCURACY = 1_000, 10_000


def order_statistics(df: DataFrame, column: str, ranks: list[int], few: int = FEW) -> dict[int, float]:
    """The values of some ranks (from 0) among the non-null values of a column.

    A sketch brackets each rank, one aggregate counts what lies below and within each bracket, and the brackets narrow
    until they hold few distinct values, whose counts, combined before they move, settle the rank. Tasks hold sketches and
    counts only; the driver gets at most `few` values a rank. Every pass reads the column, and a bracket narrows about by
    a thousandth each.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    # (low, high, values below low): the rank's value lies within low and high
    first = values.agg(F.min("v"), F.max("v")).first()
    open_, found = {k: (first[0], first[1]) for k in set(ranks)}, {}
    while open_:
        inside = lambda k: F.col("v").between(F.lit(open_[k][0]), F.lit(open_[k][1]))  # noqa: B023, E731
        aggs = [c for k in open_ for c in (F.count_if(F.col("v") < open_[k][0]).alias(f"b{k}"), F.count_if(inside(k)).alias(f"n{k}"), F.approx_count_distinct(F.when(inside(k), F.col("v"))).alias(f"d{k}"))]
        row = values.agg(*aggs).first()
        for k, (low, high) in list(open_.items()):
            below, n, distinct = row[f"b{k}"], row[f"n{k}"], row[f"d{k}"]
            within = values.where(F.col("v").between(low, high))
            if low == high:
                found[k] = low
            elif distinct <= few // 2:
                counts = within.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(2 * few).collect()
                for r in counts:
                    below += r.n
                    if k < below:
                        found[k] = r.v
                        break
            else:
                share = (k - below + 0.5) / n
                margin = 4 / ACCURACY
                ends = within.agg(F.percentile_approx("v", [max(0.0, share - margin), min(1.0, share + margin)], ACCURACY)).first()[0]
                fits = within.agg(F.count_if(F.col("v") < ends[0]), F.count_if(F.col("v") <= ends[1])).first()
                a, b = (ends[0] if below + fits[0] <= k else low), (ends[1] if k < below + fits[1] else high)
                # a bracket that doesn't narrow is cut at its middle value
                if (a, b) == (low, high):
                    cut = within.agg(F.percentile_approx("v", 0.5, ACCURACY)).first()[0]
                    under = below + within.agg(F.count_if(F.col("v") <= cut)).first()[0]
                    a, b = (low, cut) if k < under else (within.where(F.col("v") > cut).agg(F.min("v")).first()[0], high)
                open_[k] = (a, b)
            if k in found:
                del open_[k]
    return found


def exact_percentiles(df: DataFrame, column: str, shares: list[float], few: int = FEW) -> list[float | None]:
    """Linearly interpolated percentiles; nulls don't count, without any value all are null."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = order_statistics(df, column, sorted({f for p in places for f in (math.floor(p), math.ceil(p))}), few)
    between = lambda low, high, share: low if low == high else low + share * (high - low)
    return [between(at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)) for p in places]
