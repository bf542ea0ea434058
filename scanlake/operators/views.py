"""What reports and screens ask of the tables: windows of a grid, display values, extents, records of regions and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import directional_difference, lit
from scanlake.operators.grid import Grid
from scanlake.operators.points import nearest
from scanlake.operators.shared import small_side, written


def _clamped(x: str, low: float, high: float, otherwise: float) -> Column:
    return F.coalesce(F.greatest(lit(low), F.least(lit(high), F.col(x))), lit(otherwise))


def zoom_bounds(wanted: DataFrame, g: Grid) -> DataFrame:
    """wanted (rt_min, rt_max, mz_min, mz_max; null is open) with low_ and high_ of rt and mz: cut to the grid, put in order, and of a bin's
    span at least (less where the grid ends)."""
    out = wanted
    for c, low, high, n in (("rt", g.rt_min, g.rt_max, g.rt_bins), ("mz", g.mz_min, g.mz_max, g.mz_bins)):
        a, b = _clamped(f"{c}_min", low, high, low), _clamped(f"{c}_max", low, high, high)
        first, last = F.least(a, b), F.greatest(a, b)
        span = max((high - low) / max(n, 1), 1e-6)
        out = out.withColumn(f"low_{c}", first).withColumn(f"high_{c}", F.when(last <= first, F.least(lit(high), first + span)).otherwise(last))
    return out


def index_bounds(wanted: DataFrame, g: Grid) -> DataFrame:
    """wanted with the cells that each window touches: {rt,mz}_offset, {rt,mz}_count and the bounds of those cells."""
    out = wanted
    for c, low, high, n in (("rt", g.rt_min, g.rt_max, g.rt_bins), ("mz", g.mz_min, g.mz_max, g.mz_bins)):
        step = (high - low) / n
        a, b = _clamped(f"{c}_min", low, high, low), _clamped(f"{c}_max", low, high, high)
        first, last = F.least(a, b), F.greatest(a, b)
        start = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((first - low) / step)))
        end = F.greatest(start + 1, F.least(F.lit(n), F.floor((last - low + step - 1e-12) / step) + 1))
        out = out.withColumn(f"{c}_offset", start.cast("int")).withColumn(f"{c}_count", (end - start).cast("int"))
        out = out.withColumn(f"window_{c}_min", low + F.col(f"{c}_offset") * step).withColumn(f"window_{c}_max", low + (F.col(f"{c}_offset") + F.col(f"{c}_count")) * step)
    return out


def mz_tolerance_of(g: Grid) -> float:
    """Half a bin, at least 0.1."""
    return max(g.mz_step / 2, 0.1)


def display_values(cells: DataFrame, near: DataFrame, pair: bool = False) -> DataFrame:
    """(mode, mz_index, rt_index, value) of each display mode: similarity, difference (signed for pairs: cells hold reference_norm and
    sample_norm) and the samples' mean raw and normalised intensities where one has any."""
    diff = directional_difference(F.col("score"), F.col("sample_norm"), F.col("reference_norm")) if pair else 1 - F.col("score")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("value")) for m, v in (("similarity", F.col("score")), ("difference", diff))])
    x = cells.select("mz_index", "rt_index", F.explode(modes).alias("_m")).select("_m.mode", "mz_index", "rt_index", "_m.value")
    means = near.groupBy("mz_index", "rt_index").agg(*[F.when(F.max(c) > 0, F.avg(c)).alias(c) for c in ("raw", "norm")])
    modes = F.array(F.struct(F.lit("raw_intensity").alias("mode"), F.col("raw").alias("value")), F.struct(F.lit("normalized_intensity").alias("mode"), F.col("norm").alias("value")))
    y = means.select("mz_index", "rt_index", F.explode(modes).alias("_m")).select("_m.mode", "mz_index", "rt_index", "_m.value").where("value IS NOT NULL")
    return x.unionByName(y)


def color_domain(values: DataFrame, g: Grid, pair: bool = False) -> DataFrame:
    """(mode, low, high, valid, null_count): 1% and 99% quantiles of each mode's values; even about 0 for the signed difference."""
    q = lambda p: F.expr(f"percentile(value, {p})")
    x = values.groupBy("mode").agg(q(0.01).alias("low"), q(0.99).alias("high"), F.count("value").alias("valid"))
    if pair:
        even = F.greatest(F.abs("low"), F.abs("high"), lit(1e-6))
        signed = F.col("mode") == "difference"
        x = x.withColumn("_e", even).select("mode", F.when(signed, -F.col("_e")).otherwise(F.col("low")).alias("low"), F.when(signed, F.col("_e")).otherwise(F.col("high")).alias("high"), "valid")
    return x.withColumn("null_count", F.lit(g.rt_bins * g.mz_bins) - F.col("valid"))


def pair_regions(scores: DataFrame, g: Grid, reference: str, sample: str) -> DataFrame:
    """Region records of a pair's scored cells: bounds, intensities, presence, fold change, type."""
    x = scores
    for c, low, step in (("rt", g.rt_min, g.rt_step), ("mz", g.mz_min, g.mz_step)):
        at = F.col(f"{c}_index")
        x = x.withColumn(c, low + (at + 0.5) * step).withColumn(f"{c}_start", low + at * step).withColumn(f"{c}_end", low + (at + 1) * step)
    present = F.concat_ws("|", *[F.when(F.col(f"{side}_raw") > 0, F.lit(name)) for side, name in (("reference", reference), ("sample", sample))])
    return x.select(
        "mz_index", "rt_index", "rt", "rt_start", "rt_end", "mz", "mz_start", "mz_end", "score", "difference_score", F.col("reference_norm").alias("reference_intensity"), F.col("sample_norm").alias("sample_intensity"),
        F.col("reference_raw").alias("reference_raw_intensity"), F.col("sample_raw").alias("sample_raw_intensity"), "max_intensity", present.alias("sample_presence"), "group_mean_intensity", "fold_change", "difference_type",
        F.lit(False).alias("saved_as_feature"),
    )


def traces(scans: DataFrame, points: DataFrame, shifts: DataFrame, cells: DataFrame, tolerance: float) -> DataFrame:
    """(cells' mz_index, rt_index; sample_id, scan_id, raw_rt, aligned_rt, rt_delta, intensity): for each cell (rt, mz) and sample the
    scan nearest in aligned RT and its intensity within tolerance of the m/z."""
    s = scans.join(shifts.select("sample_id", "rt_shift"), "sample_id").select("sample_id", "scan_id", F.col("rt").alias("raw_rt"), (F.col("rt") + F.col("rt_shift")).alias("aligned_rt"))
    wanted = cells.select("mz_index", "rt_index", F.col("rt").alias("wanted_rt"), F.col("mz").alias("_mz"))
    x = nearest(s, wanted, F.col("aligned_rt"), ["sample_id"], ["raw_rt", "scan_id"]).withColumn("rt_delta", F.abs(F.col("aligned_rt") - F.col("wanted_rt"))).drop("_rt", "wanted_rt")
    x = written(x, "traces")
    found = small_side(x.select("mz_index", "rt_index", "sample_id", "scan_id", "_mz"))
    hit = points.select("sample_id", "scan_id", "mz", "intensity").join(found, ["sample_id", "scan_id"]).where(F.abs(F.col("mz") - F.col("_mz")) <= tolerance)
    hit = hit.groupBy("mz_index", "rt_index", "sample_id").agg(F.sum("intensity").alias("intensity"))
    return x.drop("_mz").join(hit, ["mz_index", "rt_index", "sample_id"], "left").na.fill({"intensity": 0.0})


def cell_features(regions: DataFrame, near: DataFrame, trace: DataFrame, g: Grid, heatmap_id: str, top: int = 20) -> DataFrame:
    """Saved-feature records of the first `top` regions (region_rank): bounds, scores, presence, fold change, type, and JSON of each sample's
    intensities and source scan."""
    x = regions.where(F.col("region_rank") <= top)
    cells = near.join(x.select("mz_index", "rt_index"), ["mz_index", "rt_index"])
    p = F.when(F.col("norm") > 0, F.col("norm"))
    entry = lambda *c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_id", F.struct(*c)))))
    s = cells.groupBy("mz_index", "rt_index").agg(
        F.when(F.count(p) >= 2, (F.max(p) + 1e-12) / (F.min(p) + 1e-12)).otherwise(lit(1)).alias("_fold"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("raw") > 0, F.col("sample_id")))), "|").alias("sample_presence"),
        F.sum((F.col("raw") > 0).cast("int")).alias("_n"), F.count(F.lit(1)).alias("_s"), entry(F.col("raw"), F.col("norm").alias("normalized")).alias("sample_intensities"),
    )
    t = trace.groupBy("mz_index", "rt_index").agg(entry("scan_id", "raw_rt", "aligned_rt").alias("source_scans"))
    kind = F.when((F.col("_n") > 0) & (F.col("_n") < F.col("_s")), "new_signal").when(F.col("_fold") >= 1.5, "intensity_increased").when(F.col("_fold") <= 1 / 1.5, "intensity_decreased").otherwise("uncertain")
    x = x.drop("difference_type").join(s, ["mz_index", "rt_index"]).join(t, ["mz_index", "rt_index"], "left")
    bound = lambda c, i: lit(getattr(g, f"{c}_min")) + (F.col(f"{c}_index") + i) * getattr(g, f"{c}_step")
    return x.select(
        F.format_string("LCMSF_%05d", "region_rank").alias("feature_id"), F.lit(heatmap_id).alias("heatmap_id"), F.col("rt").alias("aligned_rt"), bound("rt", 0).alias("rt_start"), bound("rt", 1).alias("rt_end"), "mz",
        bound("mz", 0).alias("mz_start"), bound("mz", 1).alias("mz_end"), F.col("score").alias("similarity_score"), (1 - F.col("score")).alias("difference_score"), "weighted_difference_score", "sample_presence", F.col("_fold").alias("fold_change"),
        kind.alias("difference_type"), "sample_intensities", "source_scans",
    )


def not_saved(features: DataFrame, saved: DataFrame) -> DataFrame:
    """features without those that are saved already: the same heat map, RT and m/z to nine digits."""
    keys = lambda df: df.withColumn("_rt", F.bround("aligned_rt", 9)).withColumn("_mz", F.bround("mz", 9))
    return keys(features).join(keys(saved).select("heatmap_id", "_rt", "_mz"), ["heatmap_id", "_rt", "_mz"], "left_anti").drop("_rt", "_mz")


def group_order(groups: DataFrame) -> DataFrame:
    """groups with group_rank: common features last, then by falling confidence, then by RT. A row per group."""
    order = [F.col("difference_type") == "common_feature", F.desc(F.bround("confidence_score", 9)), "representative_rt", "feature_group_id"]
    return groups.withColumn("group_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def feature_map(groups: DataFrame) -> DataFrame:
    """Global features that a map can show (RT, m/z and area above 0) with feature_rank, their place in the list."""
    order = [F.desc("ranking_score"), F.desc("difference_score"), F.desc("max_area"), "representative_rt", "feature_group_id"]
    x = groups.where("representative_rt > 0 AND representative_mz > 0 AND max_area > 0")
    return x.withColumn("feature_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def map_extent(rows: DataFrame) -> DataFrame:
    """(xmin, xmax, ymin, ymax) of the feature map: RT and m/z with 4% to either side (0.05 min and 1 at least); 0 to 1 without rows."""
    x = rows.agg(F.min("representative_rt").alias("a"), F.max("representative_rt").alias("b"), F.min("representative_mz").alias("c"), F.max("representative_mz").alias("d"))
    xpad, ypad = F.greatest((F.col("b") - F.col("a")) * 0.04, lit(0.05)), F.greatest((F.col("d") - F.col("c")) * 0.04, lit(1))
    or_ = lambda v, z: F.coalesce(F.when(F.col("a").isNotNull(), v), lit(z))
    return x.select(or_(F.col("a") - xpad, 0).alias("xmin"), or_(F.col("b") + xpad, 1).alias("xmax"), or_(F.greatest(lit(0), F.col("c") - ypad), 0).alias("ymin"), or_(F.col("d") + ypad, 1).alias("ymax"))


def changes_of_groups(groups: DataFrame, top: int = 20) -> DataFrame:
    """The changed-m/z list that feature groups give: the first `top` of each peak by candidate_rank, as m/z, presence, change and ranking."""
    return groups.where(F.col("candidate_rank") <= top).select(
        "peak_id", "candidate_rank", F.col("representative_mz").alias("mz"), "feature_group_id", "representative_rt", F.col("sample_count").alias("presence_count"),
        F.expr("aggregate(map_values(area_by_sample), 0D, (a, x) -> a + x) / size(area_by_sample)").alias("mean_intensity"), "cv", "max_fold_change", "difference_type",
        F.col("difference_score").alias("contribution_to_spectrum_difference"), F.col("abundance_weighted_score").alias("ranking_score"),
    )


def peak_feature_record(peaks: DataFrame, areas: DataFrame, mz: float, tolerance: float) -> DataFrame:
    """A saved feature per peak of peaks (peak_id, rt_start, rt_apex, rt_end, peak_consistency_score, spectrum_score) from the areas of an XIC
    (peak_id, sample_id, area) at mz; its difference is what consistency lacks."""
    a = areas.groupBy("peak_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_id", "area")))).alias("raw_area_by_sample"))
    return peaks.join(a, "peak_id").select(
        F.format_string("PF_%05d", F.col("peak_id").cast("int")).alias("feature_id"), F.col("peak_id").alias("parent_tic_peak_id"), lit(mz).alias("representative_mz"), lit(tolerance).alias("mz_tolerance"), "rt_start", "rt_apex", "rt_end",
        "raw_area_by_sample", (1 - F.col("peak_consistency_score")).alias("difference_score"), "peak_consistency_score", "spectrum_score", F.lit("peak_first_local_analysis").alias("source"), F.lit("unannotated").alias("annotation_status"),
    )


def curve_in_scan_order(scans: DataFrame, shifts: DataFrame, signal: str = "tic") -> DataFrame:
    """(sample_id, scan_ord, rt, value): TIC or BPC as the file has it (scan_ord), RT shifted by the sample's shift."""
    x = scans.join(shifts.select("sample_id", "rt_shift"), "sample_id", "left")
    return x.select("sample_id", "scan_ord", (F.col("rt") + F.coalesce("rt_shift", lit(0))).alias("rt"), F.col("bpi" if signal == "bpc" else "tic").alias("value"))


def main_peak_shifts(mains: DataFrame, reference: str) -> DataFrame:
    """(sample_id, rt_shift): every sample's main peak is brought to the reference's; 0 where one of them is missing."""
    ref = mains.where(F.col("sample_id") == reference).select(F.col("apex_time_min").alias("_ref"))
    x = mains.select("sample_id", "apex_time_min").join(ref, how="left")
    return x.select("sample_id", F.coalesce(F.col("_ref") - F.col("apex_time_min"), lit(0)).alias("rt_shift"))


def main_peak_cv(alignment: DataFrame) -> DataFrame:
    """(main_peak_rt_cv): CV of the samples' apexes; null for fewer than two, or a mean of 0."""
    a = F.col("apex_rt")
    return alignment.agg(F.when((F.count(a) >= 2) & (F.avg(a) != 0), F.stddev_pop(a) / F.avg(a)).alias("main_peak_rt_cv"))


def view_extents(scans: DataFrame, points: DataFrame, mz_min: float, mz_max: float) -> DataFrame:
    """(sample_id, rt_min, rt_max, value_max, spectrum_max): what a chromatogram and a spectrum window of each sample span."""
    c = scans.groupBy("sample_id").agg(F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.max("tic").alias("value_max"))
    s = points.where(F.col("mz").between(mz_min, mz_max)).groupBy("sample_id").agg(F.max("intensity").alias("spectrum_max"))
    return c.join(s, "sample_id", "left").na.fill({"spectrum_max": 0.0})
