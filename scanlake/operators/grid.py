"""The RT x m/z grid: binning, normalisation, neighbourhood maxima, similarity scores and difference regions.

Cells are long rows (sample_id, mz_index, rt_index, raw) of occupied cells and their neighbours; no grid is made whole.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import cohort_difference_type, cv, lit, pair_difference_type, ratio, signal_status, similarity


class Grid:
    """Bounds and bin counts, and the neighbourhood radii that follow from them."""

    def __init__(self, rt_min: float, rt_max: float, mz_min: float, mz_max: float, rt_bins: int = 180, mz_bins: int = 160):
        self.rt_min, self.rt_max, self.mz_min, self.mz_max, self.rt_bins, self.mz_bins = rt_min, rt_max, mz_min, mz_max, rt_bins, mz_bins
        self.rt_step, self.mz_step = (rt_max - rt_min) / rt_bins, (mz_max - mz_min) / mz_bins
        self.rt_radius = max(1, min(5, math.ceil(0.15 / max(self.rt_step, 1e-9))))
        self.mz_radius = max(1, min(3, math.ceil(1.0 / max(self.mz_step, 1e-9))))

    @classmethod
    def zoom(cls, rt_min: float, rt_max: float, mz_min: float, mz_max: float) -> Grid:
        """A window's own grid: bins of about 0.05 min, 20 to 600 of them, and 1 m/z, 30 to 400."""
        rt_min, rt_max = sorted((rt_min, rt_max))
        mz_min, mz_max = sorted((mz_min, mz_max))
        count = lambda span, target, low, high: max(low, min(high, math.ceil(span / target)))
        return cls(rt_min, rt_max, mz_min, mz_max, count(rt_max - rt_min, 0.05, 20, 600), count(mz_max - mz_min, 1.0, 30, 400))


def cells(points: DataFrame, g: Grid) -> DataFrame:
    """(sample_id, mz_index, rt_index, raw): summed intensities. Indexes truncate towards zero, so values less than a step below
    the minimum fall in bin 0; the maximum itself falls outside."""
    at = lambda c, low, step: ((F.col(c) - low) / step).cast("int")
    # limits on the values themselves reach the scan and keep the casts in range
    x = points.where((F.col("rt") > g.rt_min - g.rt_step) & (F.col("rt") < g.rt_max + g.rt_step) & (F.col("mz") > g.mz_min - g.mz_step) & (F.col("mz") < g.mz_max + g.mz_step))
    x = x.select("sample_id", at("mz", g.mz_min, g.mz_step).alias("mz_index"), at("rt", g.rt_min, g.rt_step).alias("rt_index"), "intensity")
    x = x.where(F.col("mz_index").between(0, g.mz_bins - 1) & F.col("rt_index").between(0, g.rt_bins - 1))
    return x.groupBy("sample_id", "mz_index", "rt_index").agg(F.sum("intensity").alias("raw"))


def factors(c: DataFrame) -> DataFrame:
    """(sample_id, none, tic, max, median, floor) over positive cells; factors are 1 and the floor 0 without any."""
    p = F.when(F.col("raw") > 0, F.col("raw"))
    one = lambda x: F.coalesce(x, lit(1))
    floor = F.coalesce(F.greatest(F.max(p) * 0.01, F.percentile(p, lit(0.05))), lit(0))
    return c.groupBy("sample_id").agg(lit(1).alias("none"), one(F.sum(p)).alias("tic"), one(F.max(p)).alias("max"), one(F.median(p)).alias("median"), floor.alias("floor"))


def normalised(raw, method: str):
    if method == "none":
        return raw
    if method == "tic_log1p":
        return F.log1p(raw / F.col("tic") * 1e6)
    return raw / F.col(method)


def local_max(c: DataFrame, g: Grid) -> DataFrame:
    """(sample_id, mz_index, rt_index, near): the maximum over each cell's neighbourhood, where it is positive.

    Positive cells give their value to the cells around them, first along RT, then along m/z, so the work goes by occupied cells and
    not by the size of the grid.
    """
    x = c.where("raw > 0").select("sample_id", "mz_index", "rt_index", F.col("raw").alias("near"))
    for at, radius, n in (("rt_index", g.rt_radius, g.rt_bins), ("mz_index", g.mz_radius, g.mz_bins)):
        around = F.sequence(F.greatest(F.lit(0), F.col(at) - radius), F.least(F.lit(n - 1), F.col(at) + radius))
        x = x.withColumn(at, F.explode(around)).groupBy("sample_id", "mz_index", "rt_index").agg(F.max("near").alias("near"))
    return x


def neighbourhood(c: DataFrame, g: Grid, samples: DataFrame, method: str = "tic_log1p") -> DataFrame:
    """(sample_id, mz_index, rt_index, raw, norm): neighbourhood maxima of every sample of samples in each cell that has one in some
    sample, 0 below the sample's signal floor or without any.

    Normalisation is monotone within a sample, so the maximum of normalised cells is the normalised maximum.
    """
    near = local_max(c, g)
    d = near.select("mz_index", "rt_index").distinct().crossJoin(samples.select("sample_id"))
    d = d.join(near, ["sample_id", "mz_index", "rt_index"], "left").join(factors(c), "sample_id", "left").na.fill(0.0, ["near"])
    raw = F.when(F.col("near") < F.coalesce("floor", lit(0)), lit(0)).otherwise(F.col("near"))
    d = d.withColumn("_raw", raw).na.fill(1.0, ["tic", "max", "median"])
    norm = F.when(F.col("_raw") > 0, normalised(F.col("_raw"), method)).otherwise(lit(0))
    return d.select("sample_id", "mz_index", "rt_index", F.col("_raw").alias("raw"), norm.alias("norm"))


def cohort_scores(near: DataFrame) -> DataFrame:
    """One row per cell with signal: score 1 / (1 + CV over samples) and what a difference region needs."""
    p = F.when(F.col("norm") > 0, F.col("norm"))
    x = near.groupBy("mz_index", "rt_index").agg(
        F.max("raw").alias("max_intensity"),
        F.avg("norm").alias("group_mean_intensity"),
        cv(F.col("norm")).alias("cv"),
        F.sum((F.col("raw") > 0).cast("int")).cast("int").alias("present"),
        F.count(F.lit(1)).cast("int").alias("samples"),
        F.when(F.count(p) >= 2, (F.max(p) + 1e-12) / (F.min(p) + 1e-12)).alias("fold_change"),
    )
    x = x.where("max_intensity > 0").withColumn("score", F.coalesce(1 / (1 + F.col("cv")), lit(0)))
    return x.withColumn("signal_status", signal_status(F.col("present"), F.col("samples")))


def regions(scores: DataFrame, g: Grid, below: float = 0.75) -> DataFrame:
    """Cells scoring under `below`, with bounds, type and abundance weights."""
    x = scores.where(F.col("score") < below)
    x = x.withColumn("rt", g.rt_min + (F.col("rt_index") + 0.5) * g.rt_step).withColumn("mz", g.mz_min + (F.col("mz_index") + 0.5) * g.mz_step)
    x = x.withColumn("difference_score", 1 - F.col("score")).withColumn("difference_type", cohort_difference_type(F.col("present"), F.col("samples"), F.col("fold_change"), F.col("score")))
    return abundance_weighted(x)


def abundance_weighted(x: DataFrame) -> DataFrame:
    """Adds abundance_weight, min(1, sqrt(mean / 90% quantile of positive means)), and weighted_difference_score."""
    q = x.where("group_mean_intensity > 0").agg(F.coalesce(F.expr("percentile(group_mean_intensity, 0.9)"), lit(0)).alias("_q"))
    w = F.when((F.col("_q") > 0) & (F.col("group_mean_intensity") > 0), F.least(lit(1), F.sqrt(F.col("group_mean_intensity") / F.col("_q")))).otherwise(lit(0))
    return x.crossJoin(F.broadcast(q)).withColumn("abundance_weight", w).withColumn("weighted_difference_score", F.col("difference_score") * F.col("abundance_weight")).drop("_q")


REGION_ORDER = (("weighted_difference_score", False), ("difference_score", False), ("max_intensity", False), ("mz_index", True), ("rt_index", True))


def ranked(r: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in REGION_ORDER]
    return r.withColumn("region_rank", F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(*order)))


def distinct_regions(r: DataFrame, g: Grid, limit: int = 80, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice in rank order: a region near a chosen one, in both indexes, goes; the first `limit` of each heat map (by) stay.

    A chosen region takes (4 rt_radius + 1) * (4 mz_radius + 1) cells away at most, itself among them, so `limit` of them are found among so many times
    as many of the first ranks: whatever the size of the grid, one task folds a bounded number of rows.
    """
    columns = list(REGION_ORDER)
    most = limit * (4 * g.rt_radius + 1) * (4 * g.mz_radius + 1)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c, _ in columns], ascending=[up for _, up in columns], kind="stable")
        rt, mz = rows["rt_index"].to_numpy(), rows["mz_index"].to_numpy()
        open_ = pd.Series(True, index=range(len(rows))).to_numpy()
        kept = []
        for i in range(len(rows)):
            if open_[i]:
                kept.append(i)
                if len(kept) == limit:
                    break
                open_ &= (abs(rt - rt[i]) > 2 * g.rt_radius) | (abs(mz - mz[i]) > 2 * g.mz_radius)
        out = rows.iloc[kept].copy()
        out["region_rank"] = range(1, len(out) + 1)
        return out

    first = ranked(r, by).where(F.col("region_rank") <= most)
    if by:
        return first.groupBy(*by).applyInPandas(choose, first.schema)
    return first.withColumn("_map", F.lit(0)).groupBy("_map").applyInPandas(lambda rows: choose(rows.drop(columns="_map")), first.schema)


def pair_scores(near: DataFrame, reference: str, sample: str) -> DataFrame:
    """Cells of two samples: similarity of the normalised neighbourhoods, difference type; cells without signal go."""
    pick = lambda who, c: F.max(F.when(F.col("sample_id") == who, F.col(c)))
    x = near.where(F.col("sample_id").isin(reference, sample)).groupBy("mz_index", "rt_index")
    x = x.agg(pick(reference, "raw").alias("reference_raw"), pick(sample, "raw").alias("sample_raw"), pick(reference, "norm").alias("reference_norm"), pick(sample, "norm").alias("sample_norm"))
    x = x.where("reference_raw > 0 OR sample_raw > 0").withColumn("score", similarity(F.col("reference_norm"), F.col("sample_norm")))
    x = x.withColumn("difference_type", pair_difference_type(*[F.col(c) for c in ("reference_raw", "sample_raw", "reference_norm", "sample_norm", "score")]))
    x = x.withColumn("fold_change", (F.col("sample_norm") + 1e-12) / (F.col("reference_norm") + 1e-12))
    return x.withColumn("max_intensity", F.greatest("reference_raw", "sample_raw")).withColumn("group_mean_intensity", (F.col("reference_norm") + F.col("sample_norm")) / 2).withColumn("difference_score", 1 - F.col("score"))


def window(c: DataFrame, g: Grid, rt_min: float, rt_max: float, mz_min: float, mz_max: float) -> DataFrame:
    """The cells that a window touches; bounds are cut to the grid and may be given in either order."""

    def ends(a, b, low, high, n):
        step = (high - low) / n
        a, b = sorted(max(low, min(high, x)) for x in (a, b))
        first = min(n - 1, int((a - low) // step))
        return first, max(first + 1, min(n, int((b - low + step - 1e-12) // step) + 1))

    r0, r1 = ends(rt_min, rt_max, g.rt_min, g.rt_max, g.rt_bins)
    m0, m1 = ends(mz_min, mz_max, g.mz_min, g.mz_max, g.mz_bins)
    return c.where(F.col("rt_index").between(r0, r1 - 1) & F.col("mz_index").between(m0, m1 - 1))


def effective_rt_range(scans: DataFrame, low: float, high: float) -> DataFrame:
    """(rt_min, rt_max): the requested range cut to the scans' own; their own where nothing is left; the request without scans."""
    a, b = F.greatest(lit(low), F.min("rt")), F.least(lit(high), F.max("rt"))
    x = scans.agg(a.alias("a"), b.alias("b"), F.min("rt").alias("lo"), F.max("rt").alias("hi"))
    whole = F.col("b") <= F.col("a")
    return x.select(F.when(F.col("lo").isNull(), lit(low)).when(whole, F.col("lo")).otherwise(F.col("a")).alias("rt_min"), F.when(F.col("hi").isNull(), lit(high)).when(whole, F.col("hi")).otherwise(F.col("b")).alias("rt_max"))


def cell_intensities(c: DataFrame, g: Grid, rt: float, mz: float) -> DataFrame:
    """(sample_id, raw, relative_percent) of the cell at (rt, mz)."""
    x = c.where((F.col("rt_index") == int((rt - g.rt_min) / g.rt_step)) & (F.col("mz_index") == int((mz - g.mz_min) / g.mz_step)))
    most = x.agg(F.max("raw").alias("_m"))
    return x.crossJoin(F.broadcast(most)).select("sample_id", "raw", (ratio(F.col("raw"), F.col("_m")) * 100).alias("relative_percent"))
