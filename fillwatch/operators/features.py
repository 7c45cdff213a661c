"""Features of fill-level logs. Every window is keyed by bin, so the whole table costs one exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["fill_pct", "fill_rate_1h", "fill_rate_6h", "hist_avg_rate_same_slot", "time_since_reset_hours", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"]
SECOND = 1_000_000
HOUR = 3600.0 * SECOND
BARRIER, RESET, RATE_LIMIT = 30.0, 35.0, 50.0


def us(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def timed(df: DataFrame) -> DataFrame:
    """With `_us`, the time in microseconds that all windows are ordered by; added once, it keeps one sort order for all."""
    return df if "_us" in df.columns else df.withColumn("_us", us())


def clip(c: Column, low: float, high: float) -> Column:
    """greatest and least skip nulls; a null stays null here."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def add_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Cyclic hour (minutes count, seconds don't) and weekday (Monday 0) in UTC, weekend flag."""
    hour, day = F.hour(ts) + F.minute(ts) / 60.0, F.weekday(ts)
    turn = 2 * math.pi
    return df.withColumns({"hour_sin": F.sin(hour * turn / 24), "hour_cos": F.cos(hour * turn / 24), "dow_sin": F.sin(day * turn / 7), "dow_cos": F.cos(day * turn / 7), "is_weekend": (day >= 5).cast("int")})


#: What windows are keyed by. More columns than the bin cost no other exchange.
BY = ("bin_id",)


def dedup_last(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One row per bin and time, the last by seq. A look at the next row of the bin needs no key of its own."""
    w = Window.partitionBy(*by).orderBy("_us", "seq")
    return timed(df).withColumn("_next", F.lead("_us").over(w)).where(F.col("_next").isNull() | (F.col("_next") != F.col("_us"))).select(*df.columns)


#: Ages in seconds: nearest allowed, aimed at, farthest allowed.
BANDS = {1: (900, 3600, 7200), 2: (5400, 21600, 32400)}


def add_rate_features(df: DataFrame, barrier: float = BARRIER, deduped: bool = False, by: tuple[str, ...] = BY) -> DataFrame:
    """fill_rate_1h and fill_rate_6h in points an hour, by elapsed time, never across a drop of more than `barrier`.

    1 h: the reading nearest to an hour old within 15 min .. 2 h, else the one before if 1 min .. 24 h old. 6 h: nearest
    to six hours within 1.5 .. 9 h, else the 1 h rate before clipping; ties go to the later. No earlier reading: 0. Both
    end within +-50.

    All windows are of one order, by time within the bin. Each reading carries its segment's number and first reading and
    the reading after it; the last one that is as old as aimed at, at the end of a frame that only grows, then knows both
    neighbours of the age. So a row costs the same however dense the log is.
    """
    columns, df = df.columns, timed(df)
    df = df if deduped else dedup_last(df, by)
    w = Window.partitionBy(*by).orderBy("_us")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.col("_us").alias("us"), F.col("fill_pct").alias("fill"))
    x = df.withColumns({"_step": F.col("fill_pct") - F.lag("fill_pct").over(w), "_dt": F.col("_us") - F.lag("_us").over(w), "_after": F.lead(here).over(w)})
    begins = F.lag("_us").over(w).isNull() | (F.col("_step") < -barrier)
    x = x.withColumns({"_start": F.last(F.when(begins, here), ignorenulls=True).over(run)})
    point = F.struct("_us", "fill_pct", F.col("_start.us").alias("start"), "_after")
    x = x.withColumns({f"_aimed{k}": F.last(point).over(w.rangeBetween(Window.unboundedPreceding, -aim * SECOND)) for k, (_, aim, _) in BANDS.items()})

    def nearest(k: int) -> Column:
        """The reading of the segment nearest to the age aimed at, within the band."""
        young, aim, old = (b * SECOND for b in BANDS[k])
        last, age = F.col(f"_aimed{k}"), lambda p: F.col("_us") - p["us"]
        same = last["start"] == F.col("_start.us")
        older = F.when(same & (F.col("_us") - last["_us"] <= old), F.struct(last["_us"].alias("us"), last["fill_pct"].alias("fill")))
        newer = F.when(same, last["_after"]).otherwise(F.col("_start"))
        newer = F.when(age(newer) >= young, newer)
        return F.when(older.isNull() | (aim - age(newer) <= age(older) - aim), F.coalesce(newer, older)).otherwise(older)

    x = x.withColumns({"_one": nearest(1), "_six": nearest(2)})
    rate = lambda p: F.when((F.col("_us") - p["us"]) / HOUR > 0.01, (F.col("fill_pct") - p["fill"]) / ((F.col("_us") - p["us"]) / HOUR)).otherwise(0.0)
    usable = F.col("_dt").between(60 * SECOND, 86400 * SECOND) & (F.col("_step") >= -barrier)
    one = F.when(F.col("_one").isNotNull(), rate(F.col("_one"))).when(usable, F.col("_step") / (F.col("_dt") / HOUR)).otherwise(0.0)
    x = x.withColumn("_r1", one).withColumn("_r6", F.when(F.col("_six").isNotNull(), rate(F.col("_six"))).otherwise(F.col("_r1")))
    x = x.withColumn("fill_rate_1h", clip(F.col("_r1"), -RATE_LIMIT, RATE_LIMIT)).withColumn("fill_rate_6h", clip(F.col("_r6"), -RATE_LIMIT, RATE_LIMIT))
    return x.select(*columns, "fill_rate_1h", "fill_rate_6h")


def add_reset_features(df: DataFrame, drop_pct: float = RESET, by: tuple[str, ...] = BY) -> DataFrame:
    """Collections: a drop of more than drop_pct. cycle_id counts them (unless given), with hours since the last or the first reading."""
    w = Window.partitionBy(*by).orderBy("_us")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = timed(df).withColumn("_drop", F.coalesce(F.col("fill_pct") - F.lag("fill_pct").over(w) < -drop_pct, F.lit(False)))
    added = ["cycle_id"] if "cycle_id" not in df.columns else []
    if added:
        x = x.withColumn("cycle_id", F.sum(F.col("_drop").cast("long")).over(run))
    since = F.coalesce(F.last(F.when(F.col("_drop"), F.col("_us")), ignorenulls=True).over(run), F.first("_us").over(run))
    return x.withColumn("time_since_reset_hours", (F.col("_us") - since) / HOUR).select(*df.columns, *added, "time_since_reset_hours")


def add_slot_history(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """hist_avg_rate_same_slot: mean of the daily mean 1 h rates of the bin and hour over strictly earlier days, else the row's own."""
    x = timed(df).withColumn("_hour", F.hour("ts")).withColumn("_day", F.unix_date(F.to_date("ts")))
    day = Window.partitionBy(*by, "_hour", "_day").orderBy("_us")  # one sort, which serves the next window too
    x = x.withColumn("_mean", F.avg("fill_rate_1h").over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_first", F.row_number().over(day) == 1)
    before = Window.partitionBy(*by, "_hour").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    past = F.sum(F.when(F.col("_first"), F.col("_mean"))).over(before) / F.count(F.when(F.col("_first"), F.col("_mean"))).over(before)
    return x.withColumn("hist_avg_rate_same_slot", F.coalesce(past, "fill_rate_1h")).select(*df.columns, "hist_avg_rate_same_slot")


def build_feature_table(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """All ten features; one exchange (by bin). Ordering is left to whoever writes the table."""
    x = df.transform(add_time_features).transform(timed).transform(dedup_last, by).transform(add_rate_features, deduped=True, by=by).transform(add_reset_features, by=by).transform(add_slot_history, by)
    return (x if "_us" in df.columns else x.drop("_us")).fillna(0.0, ["fill_rate_1h", "fill_rate_6h", "hist_avg_rate_same_slot", "time_since_reset_hours"])


def latest_per_bin(features: DataFrame) -> DataFrame:
    """The last row of each bin, as one aggregate."""
    cols = [c for c in features.columns if c != "bin_id"]
    return features.groupBy("bin_id").agg(F.max_by(F.struct(*cols), us()).alias("r")).select("bin_id", "r.*")


def head_per_bin(df: DataFrame, n: int) -> DataFrame:
    """The first n readings of each bin."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("bin_id").orderBy(us(), "seq"))).where(F.col("_n") <= n).drop("_n")


def episode_context(df: DataFrame, level: float = 75.0, before: int = 48, otherwise: tuple[int, int] = (30, 79)) -> DataFrame:
    """Rows from `before` rows ahead of the first reading above level up to it; bins without one: rows 30 to 79 (from 0)."""
    w = Window.partitionBy("bin_id").orderBy(us(), "seq")
    x = df.withColumn("row", F.row_number().over(w) - 1)
    x = x.withColumn("_hit", F.min(F.when(F.col("fill_pct") > level, F.col("row"))).over(Window.partitionBy("bin_id")))
    return x.where(F.when(F.col("_hit").isNotNull(), F.col("row").between(F.greatest(F.lit(0), F.col("_hit") - before), F.col("_hit"))).otherwise(F.col("row").between(*otherwise))).drop("_hit")
