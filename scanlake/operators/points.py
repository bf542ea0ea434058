"""Operators on scans and centroid points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import lit, ratio


def to_points(scans: DataFrame) -> DataFrame:
    """A row per centroid; pos is its place in the scan's arrays."""
    z = F.arrays_zip("mz_array", "intensity_array")
    x = scans.select(*[c for c in scans.columns if c not in ("mz_array", "intensity_array")], F.posexplode(z).alias("pos", "_p"))
    return x.select("*", F.col("_p.mz_array").alias("mz"), F.col("_p.intensity_array").alias("intensity")).drop("_p")


def to_scans(points: DataFrame, order: list[str], by: tuple[str, ...] = ("sample_id", "scan_id", "rt")) -> DataFrame:
    """Scans with parallel arrays in the given point order, total and base peak (the first maximum)."""
    rank = F.struct(*order)
    x = points.withColumn("_p", F.struct(rank.alias("o"), "mz", "intensity"))
    x = x.groupBy(*by).agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak_intensity"), F.sort_array(F.collect_list("_p")).alias("_l"))
    first = F.get(F.filter("_l", lambda p: p["intensity"] == F.col("base_peak_intensity")), F.lit(0))["mz"]
    return x.select(*by, "tic", "base_peak_intensity", first.alias("base_peak_mz"), F.col("_l.mz").alias("mz_array"), F.col("_l.intensity").alias("intensity_array"))


def chromatogram(points: DataFrame) -> DataFrame:
    """(sample_id, scan_id, rt, tic, bpi)"""
    return points.groupBy("sample_id", "scan_id", "rt").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpi"))


def file_summary(points: DataFrame, by: str = "sample_id") -> DataFrame:
    """(by, mz_min, mz_max, rt_min, rt_max, scan_count); zeros for a file without points."""
    of = lambda f, c, out: F.coalesce(f(c), lit(0)).alias(out)
    return points.groupBy(by).agg(of(F.min, "mz", "mz_min"), of(F.max, "mz", "mz_max"), of(F.min, "rt", "rt_min"), of(F.max, "rt", "rt_max"), F.countDistinct("scan_id").alias("scan_count"))


def rt_window(df: DataFrame, start: float, end: float) -> DataFrame:
    """MS1 rows with start <= rt <= end."""
    out = df.where(F.col("rt").between(start, end))
    return out.where("ms_level = 1") if "ms_level" in df.columns else out


def select_samples(df: DataFrame, ids: list[str] = (), containing: list[str] = ()) -> DataFrame:
    """Samples listed in ids or holding any of the given pieces; all if neither is given."""
    if not ids and not containing:
        return df
    hit = F.col("sample_id").isin(list(ids))
    for x in containing:
        hit = hit | F.contains(F.col("sample_id"), F.lit(x))
    return df.where(hit)


def top_points(points: DataFrame, k: int, order: list[Column], mz_min: float | None = None, mz_max: float | None = None, least: float | None = None) -> DataFrame:
    """The k most intense points of each scan within m/z bounds; `order` breaks ties."""
    if mz_min is not None:
        points = points.where(F.col("mz").between(mz_min, mz_max))
    if least is not None:
        points = points.where(F.col("intensity") >= least)
    rank = F.row_number().over(Window.partitionBy("sample_id", "scan_id").orderBy(F.desc("intensity"), *order))
    return points.withColumn("point_rank", rank).where(F.col("point_rank") <= k)


def top_of_view(spectra: DataFrame, mz_min: float, mz_max: float, k: int, order: list[str]) -> DataFrame:
    """The k most intense peaks (peak_rank) of all spectra that a view of m/z shows; `order` breaks ties."""
    x = spectra.where(F.col("mz").between(mz_min, mz_max) & (F.col("intensity") > 0)).orderBy(F.desc("intensity"), *order).limit(k)
    return x.withColumn("peak_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("intensity"), *order)))  # k rows


def band_join(points: DataFrame, targets: DataFrame, width: float | None = None, by: tuple[str, ...] = (), ppm: float | None = None) -> DataFrame:
    """points x targets (target_mz, tolerance, others) with |mz - target_mz| <= tolerance, as an equi-join on m/z buckets, and on by.

    Targets go to every bucket that their band touches. Buckets are `width` wide, which should be about the widest tolerance, or, as
    targets from data may lie anywhere, `ppm` of the m/z. The planner broadcasts the targets where they are small.
    """
    bucket = (lambda x: F.floor(x / width)) if ppm is None else (lambda x: F.floor(F.log(F.greatest(x, lit(1e-6))) / (ppm * 1e-6)))
    t = targets.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("target_mz") - F.col("tolerance")), bucket(F.col("target_mz") + F.col("tolerance")))))
    x = points.withColumn("_bucket", bucket(F.col("mz"))).join(t, [*by, "_bucket"])
    return x.where(F.abs(F.col("mz") - F.col("target_mz")) <= F.col("tolerance")).drop("_bucket")


def nearest(scans: DataFrame, wanted: DataFrame, rt: Column, by: list[str], order: list[str]) -> DataFrame:
    """For each row of wanted (wanted_rt and others) and group `by`, the row of scans whose rt is nearest; the first by `order` wins ties.

    An as-of join: scans and wanted rows of a group are one line by RT, and each wanted row looks at the last scan before and the
    first after it. Any number of wanted rows is a sort, not a loop over scans.
    """
    keys = wanted.columns
    row = F.struct(*[c for c in scans.columns if c not in by])
    s = scans.withColumn("_rt", rt).where("_rt IS NOT NULL").withColumn("_o", F.struct(*order)).groupBy(*by, "_rt").agg(F.min_by(row, "_o").alias("_row"), F.min("_o").alias("_o"))
    w = wanted.where("wanted_rt IS NOT NULL").select(F.struct(*keys).alias("_w"), F.col("wanted_rt").alias("_rt"))
    if by:  # every group is asked for every wanted row
        w = w.withColumn("_by", F.explode(scans.agg(F.collect_set(F.struct(*by))).scalar())).select("_w", "_rt", *[F.col(f"_by.{c}").alias(c) for c in by])
    have = s.select(*by, "_rt", F.struct(F.col("_rt").alias("rt"), "_o", "_row").alias("_s"), F.lit(None).cast(w.schema["_w"].dataType).alias("_w"))
    line = have.unionByName(w.select(*by, "_rt", F.lit(None).cast(have.schema["_s"].dataType).alias("_s"), "_w"))
    of = Window.partitionBy(*(by or [F.lit(0)]))
    # at one RT the scan stands first in both directions
    last, first = of.orderBy("_rt", F.col("_s").isNull()), of.orderBy(F.desc("_rt"), F.col("_s").isNull())
    line = line.withColumn("_a", F.last("_s", True).over(last.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last("_s", True).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.rt") - F.col("_rt")).alias("d"), F.col(f"{c}._o").alias("o")))
    best = F.when(F.col("_b").isNull() | (far("_a") <= far("_b")), F.col("_a")).otherwise(F.col("_b"))
    return line.where("_w IS NOT NULL").withColumn("_s", best).where("_s IS NOT NULL").select(*by, *[F.col(f"_w.{c}").alias(c) for c in keys], F.col("_s.rt").alias("_rt"), "_s._row.*")


def merged_spectrum(points: DataFrame, width: float, by: list[str], average: bool = False) -> DataFrame:
    """(by.., mz_bin, mz, intensity): points summed by floor(mz / width + 0.5), or averaged over the number of scans."""
    x = points.withColumn("mz_bin", F.floor(F.col("mz") / width + 0.5))
    out = x.groupBy(*by, "mz_bin").agg(F.sum("intensity").alias("intensity"))
    if average:
        n = points.groupBy(*by).agg(F.countDistinct("scan_id").alias("_n"))
        out = out.join(n, by).withColumn("intensity", F.col("intensity") / F.col("_n")).drop("_n")
    return out.withColumn("mz", F.col("mz_bin") * width)


def nearest_bin(points: DataFrame, bins: DataFrame, tolerance: float, by: list[str], keys: list[str]) -> DataFrame:
    """Each point (identified by keys) with the bin (bin_index, bin_mz) of its group that is nearest within tolerance; points without one go.

    Of two as near, the bin at or above the point wins. Bucketed, so that it is an equi-join with a residual test.
    """
    t = bins.select(*by, "bin_index", F.col("bin_mz").alias("target_mz"), lit(tolerance).alias("tolerance"))
    b = lambda x: F.floor(x / tolerance)
    t = t.withColumn("_bucket", F.explode(F.sequence(b(F.col("target_mz") - tolerance), b(F.col("target_mz") + tolerance))))
    x = points.withColumn("_bucket", b(F.col("mz"))).join(t, [*by, "_bucket"]).withColumn("_d", F.abs(F.col("mz") - F.col("target_mz"))).where("_d <= tolerance")
    first = Window.partitionBy(*by, *keys).orderBy("_d", F.desc(F.col("target_mz") >= F.col("mz")), "bin_index")
    return x.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at", "_d", "_bucket", "tolerance").withColumnRenamed("target_mz", "bin_mz")


def xic(points: DataFrame, scans: DataFrame, targets: DataFrame, width: float | None = None, mode: str = "sum", ppm: float | None = None) -> DataFrame:
    """(sample_id, scan_id, rt, target_mz, intensity): extracted-ion chromatograms, with 0 where a scan has no point. targets (target_mz,
    tolerance) are those of every sample, or with a sample_id each sample's own. width and ppm are as for band_join."""
    f = {"sum": F.sum, "max": F.max}[mode]
    own = ["sample_id"] if "sample_id" in targets.columns else []
    hit = band_join(points, targets, width, tuple(own), ppm).groupBy("sample_id", "scan_id", "rt", "target_mz").agg(f("intensity").alias("intensity"))
    grid, wanted = scans.select("sample_id", "scan_id", "rt"), targets.select(*own, "target_mz")
    grid = grid.join(wanted, own) if own else grid.crossJoin(F.broadcast(wanted))
    return grid.join(hit, ["sample_id", "scan_id", "rt", "target_mz"], "left").withColumn("intensity", F.coalesce("intensity", lit(0)))


def tic_ratio(xics: DataFrame, scans: DataFrame) -> DataFrame:
    """(sample_id, target_mz, xic_sum, tic_sum, tic_ratio); the ratio is null without signal."""
    total = scans.groupBy("sample_id").agg(F.sum("tic").alias("tic_sum"))
    x = xics.groupBy("sample_id", "target_mz").agg(F.sum("intensity").alias("xic_sum"), F.max("intensity").alias("max_intensity"))
    return x.join(total, "sample_id").withColumn("tic_ratio", ratio(F.col("xic_sum"), F.col("tic_sum"), None))
