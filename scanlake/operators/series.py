"""Operators on ordered curves: rows (by.., rt, value), one curve for each value of `by`, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import lit


def curve(by: list[str]):
    return Window.partitionBy(*by).orderBy("rt")


def moving_average(df: DataFrame, value: str, window: int, by: list[str], out: str) -> DataFrame:
    """Mean over max(1, window // 2) points to either side; fewer at the ends."""
    r = max(1, window // 2)
    return df.withColumn(out, F.col(value).cast("double") if window <= 1 else F.avg(value).over(curve(by).rowsBetween(-r, r)))


def padded_average(df: DataFrame, value: str, window: int, by: list[str], out: str) -> DataFrame:
    """Mean over an odd window, the end values repeated beyond the ends; curves of fewer than three points stay."""
    if window <= 1:
        return df.withColumn(out, F.col(value).cast("double"))
    r = window // 2
    every = Window.partitionBy(*by)
    line = curve(by)
    n, at = F.count(F.lit(1)).over(every), F.row_number().over(line)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.greatest(r + 1 - at, F.lit(0)) * F.first(value).over(whole) + F.greatest(r - (n - at), F.lit(0)) * F.last(value).over(whole)
    return df.withColumn(out, F.when(n < 3, F.col(value).cast("double")).otherwise((F.sum(value).over(line.rowsBetween(-r, r)) + ends) / (2 * r + 1)))


def rolling_min(df: DataFrame, value: str, window: int, by: list[str], out: str) -> DataFrame:
    r = max(1, window // 2)
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*by) if window <= 1 else curve(by).rowsBetween(-r, r)))


def baseline(df: DataFrame, by: list[str], smoothing: int = 3, width: int = 41, body: int = 11) -> DataFrame:
    """Adds smoothed, baseline, corrected and body_corrected to a curve."""
    df = moving_average(df, "value", smoothing, by, "smoothed")
    df = rolling_min(df, "smoothed", width, by, "baseline").withColumn("corrected", F.greatest(F.col("smoothed") - F.col("baseline"), lit(0)))
    return moving_average(df, "corrected", body, by, "body_corrected")


def noise_level(df: DataFrame, by: list[str]) -> DataFrame:
    """(by.., noise_level): median + 1.4826 MAD of the corrected values up to their 40% quantile, at least the 10% quantile."""
    q = df.groupBy(*by).agg(F.expr("percentile(corrected, 0.4)").alias("_q4"), F.expr("percentile(corrected, 0.1)").alias("_q1"))
    low = df.join(q, by).where("corrected <= _q4")
    mid = low.groupBy(*by, "_q1").agg(F.median("corrected").alias("_mid"))
    away = low.drop("_q1").join(mid, by).groupBy(*by, "_mid", "_q1").agg(F.median(F.abs(F.col("corrected") - F.col("_mid"))).alias("_mad"))
    return away.select(*by, F.greatest(F.col("_mid") + 1.4826 * F.col("_mad"), F.col("_q1"), lit(1e-9)).alias("noise_level"))


def trapezoids(value: Column | str, by: list[str], floor: Column | None = None) -> Column:
    """Area between a point and the one before it, over floor (values under it count as it) if given."""
    y = F.col(value) if isinstance(value, str) else value
    y = y if floor is None else F.greatest(y - floor, lit(0))
    line = curve(by)
    dt = F.greatest(F.col("rt") - F.lag("rt").over(line), lit(0))
    return F.coalesce((F.lag(y).over(line) + y) / 2 * dt, lit(0))


def area(df: DataFrame, value: str, by: list[str], floor: Column | None = None) -> DataFrame:
    """(by.., area)"""
    return df.withColumn("_a", trapezoids(value, by, floor)).groupBy(*by).agg(F.sum("_a").alias("area"))


def robust_noise(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by.., noise): spread of the lowest max(3, n // 5) values, at least a tenth of their median and 1."""
    every = Window.partitionBy(*by)
    low = df.withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_at", F.row_number().over(every.orderBy(value)))
    low = low.where(F.col("_at") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 5)))
    spread = F.when(F.count(F.lit(1)) >= 2, F.stddev_pop(value)).otherwise(F.max(value))
    return low.groupBy(*by).agg(F.greatest(spread, F.median(value) * 0.1, lit(1)).alias("noise"))


def consensus(df: DataFrame, step: float = 0.01, most: int = 8000) -> DataFrame:
    """(rt, value): means of all curves' points in bins of about `step`; empty bins are left out. One row of bounds is broadcast."""
    ends = df.agg(F.min("rt").alias("_lo"), F.max("rt").alias("_hi"))
    bins = F.least(F.lit(most), F.greatest(F.lit(100), F.ceil((F.col("_hi") - F.col("_lo")) / step))).cast("int")
    x = df.crossJoin(F.broadcast(ends.withColumn("_bins", bins))).where("_hi > _lo").withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.col("_bins"))
    x = x.withColumn("_bin", F.least(F.col("_bins") - 1, F.greatest(F.lit(0), ((F.col("rt") - F.col("_lo")) / F.col("_step")).cast("int"))))
    x = x.groupBy("_bin", "_lo", "_step").agg(F.avg("value").alias("value"))
    return x.select((F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_step")).alias("rt"), "value")


def local_maxima(df: DataFrame, value: str, by: list[str], plateau: bool = False) -> DataFrame:
    """Inner points not below their left neighbour and above their right one (plateau: not below it)."""
    line = curve(by)
    left, right = F.lag(value).over(line), F.lead(value).over(line)
    df = df.withColumn("_l", left).withColumn("_r", right)
    return df.where((F.col(value) >= F.col("_l")) & ((F.col(value) >= F.col("_r")) if plateau else (F.col(value) > F.col("_r")))).drop("_l", "_r")


def resample(df: DataFrame, points: int, by: list[str]) -> DataFrame:
    """(by.., point, value): each curve at `points` even positions over its own range, by linear interpolation.

    Each interval between neighbours emits the positions it holds, so no join is needed.
    """
    every, line = Window.partitionBy(*by), curve(by)
    x = df.withColumn("_lo", F.min("rt").over(every)).withColumn("_hi", F.max("rt").over(every))
    x = x.withColumn("_r1", F.lead("rt").over(line)).withColumn("_v1", F.lead("value").over(line)).withColumn("_at", F.row_number().over(line))
    flat = x.where((F.col("_hi") <= F.col("_lo")) & (F.col("_at") == 1)).select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "value")
    x = x.where((F.col("_r1") > F.col("rt")) & (F.col("_hi") > F.col("_lo")))
    place = lambda r: (r - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (points - 1)
    x = x.withColumn("point", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(place(F.col("rt"))) - 1), F.least(F.lit(points - 1), F.ceil(place(F.col("_r1"))) + 1))))
    at = F.least(F.col("_hi"), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / max(1, points - 1))  # the last may pass the end by a rounding error
    x = x.withColumn("_x", at).where((F.col("_x") <= F.col("_r1")) & ((F.col("_x") > F.col("rt")) | ((F.col("_x") >= F.col("rt")) & (F.col("rt") == F.col("_lo")))))
    share = (F.col("_x") - F.col("rt")) / (F.col("_r1") - F.col("rt"))
    return x.select(*by, F.col("point").cast("int").alias("point"), (F.col("value") * (1 - share) + F.col("_v1") * share).alias("value")).unionByName(flat)
