"""Retention-time alignment: landmarks, robust shifts, local apex alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scanlake.functions import lit
from scanlake.schema import LANDMARK, PeakParams


def landmarks(peaks: DataFrame, reference: str, window: float = 3.0, most: int = 40) -> DataFrame:
    """(sample_id, LANDMARK): the reference's `most` largest peaks, in RT order, each take the nearest free one of a sample's
    2 * most largest within window. Greedy, so a sample is a group; it holds at most 3 * most rows."""
    refs = peaks.where((F.col("sample_id") == reference) & (F.col("area_rank") <= most)).select(F.col("apex_time_min").alias("rt"), "area")
    own = peaks.where((F.col("sample_id") != reference) & (F.col("area_rank") <= 2 * most)).select("sample_id", F.col("apex_time_min").alias("rt"), "area", F.col("area_rank").alias("rank"))
    rows = own.withColumn("side", F.lit(1)).unionByName(
        own.select("sample_id").distinct().crossJoin(F.broadcast(refs)).withColumn("rank", F.lit(0)).withColumn("side", F.lit(0))
    )

    def match(g: pd.DataFrame) -> pd.DataFrame:
        ref, mine = g[g["side"] == 0].sort_values("rt", kind="stable"), g[g["side"] == 1].sort_values("rank", kind="stable").reset_index(drop=True)
        free = pd.Series(True, index=mine.index)
        out = []
        for rt, size in zip(ref["rt"], ref["area"]):
            away = (mine["rt"] - rt).abs()[free]
            away = away[away <= window]
            if len(away):
                i = away.idxmin()
                free[i] = False
                out.append((g["sample_id"].iloc[0], rt, mine["rt"][i], rt - mine["rt"][i], size, mine["area"][i]))
        return pd.DataFrame(out, columns=["sample_id", *LANDMARK.names])

    return rows.groupBy("sample_id").applyInPandas(match, StructType([StructField("sample_id", rows.schema["sample_id"].dataType), *LANDMARK.fields]))


def robust_shifts(marks: DataFrame) -> DataFrame:
    """(sample_id, rt_shift, landmark_count): the median shift; from four landmarks on, without those further from it than
    max(0.05, 3.5 MAD)."""
    every = Window.partitionBy("sample_id")
    x = marks.withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_m", F.median("rt_shift").over(every))
    x = x.withColumn("_d", F.abs(F.col("rt_shift") - F.col("_m"))).withColumn("_mad", F.median("_d").over(every))
    keep = (F.col("_n") < 4) | (F.col("_mad") <= 1e-9) | (F.col("_d") <= F.greatest(lit(0.05), 3.5 * F.col("_mad")))
    whole = (F.max("_n") < 4) | (F.max("_mad") <= 1e-9)
    return x.groupBy("sample_id").agg(F.when(whole, F.max("_m")).otherwise(F.median(F.when(keep, F.col("rt_shift")))).alias("rt_shift"), F.count(F.lit(1)).alias("landmark_count"))


def match_reference(peaks: DataFrame, apex: DataFrame, window: float) -> DataFrame:
    """For each sample the peak within window of the reference apex (one row: reference_apex) with the best 0.55 area + 0.25 height +
    0.20 closeness, areas and heights relative to the largest within the window."""
    x = peaks.crossJoin(F.broadcast(apex)).withColumn("reference_delta", F.col("apex_time_min") - F.col("reference_apex")).where(F.abs("reference_delta") <= window)
    every = Window.partitionBy("sample_id")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(every), lit(0)), F.col(c))
    score = share("area") * 0.55 + share("height") * 0.25 + (1 - F.abs("reference_delta") / max(window, 1e-9)) * 0.2
    first = every.orderBy(F.desc("match_score"), "area_rank")
    return x.withColumn("match_score", score).withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")


def alignment(curves: DataFrame, peaks: DataFrame, mains: DataFrame, reference: str, window: float = 3.0) -> DataFrame:
    """(sample_id, rt_shift, apex_rt, landmark_count, match_method) for every sample of curves; the reference shifts by 0.

    With two landmarks or more the shift is their robust median, else it brings the matched or main peak to the reference's.
    """
    samples = curves.select("sample_id").distinct()
    ref = mains.where(F.col("sample_id") == reference).select(F.col("apex_time_min").alias("reference_apex"))
    ref = samples.limit(1).select(lit(0).alias("_z")).join(ref, how="left").select(F.coalesce("reference_apex", "_z").alias("reference_apex"))
    near = match_reference(peaks, ref, window).select("sample_id", F.col("apex_time_min").alias("_near"))
    x = samples.join(near, "sample_id", "left").join(mains.select("sample_id", F.col("apex_time_min").alias("_main"), F.col("match_method").alias("_how")), "sample_id", "left")
    x = x.join(robust_shifts(landmarks(peaks, reference, window)), "sample_id", "left").crossJoin(F.broadcast(ref))
    own, many = F.col("sample_id") == reference, F.coalesce(F.col("landmark_count") >= 2, F.lit(False))
    apex = F.coalesce(F.when(own, F.col("_main")).otherwise(F.coalesce("_near", "_main")), lit(0))
    found = F.col("_near").isNotNull() | F.col("_main").isNotNull()
    how = F.when(own, F.col("_how")).when(many & found, "multi_peak_landmark_median").when(F.col("_near").isNotNull(), "reference_window").when(F.col("_main").isNotNull(), "fallback_largest_area")
    shift = F.when(own, lit(0)).when(many, F.col("rt_shift")).otherwise(F.col("reference_apex") - apex)
    return x.select("sample_id", shift.alias("rt_shift"), apex.alias("apex_rt"), F.coalesce("landmark_count", F.lit(0)).alias("landmark_count"), how.alias("match_method"))


def feature_peak_alignment(scans: DataFrame, rt: float) -> DataFrame:
    """(sample_id, rt_shift, apex_rt): every sample's scan nearest to rt is brought to it."""
    x = scans.groupBy("sample_id").agg(F.min_by("rt", F.struct(F.abs(F.col("rt") - rt), "rt")).alias("apex_rt"))
    return x.select("sample_id", (rt - F.col("apex_rt")).alias("rt_shift"), "apex_rt")


def peak_windows(curves: DataFrame, peaks: DataFrame, margin: float = 0.08, shift: str | None = None, width: float = 1.0) -> DataFrame:
    """Interval join of curves with few peaks (peak_id, rt_start, rt_apex, rt_end, width): rows within a peak's margins.

    An equi-join on RT buckets of `width`: a peak goes to every bucket its window touches.
    """
    bucket = lambda x: F.floor(x / width)
    t = peaks.select("peak_id", "rt_start", "rt_apex", "rt_end", "width")
    t = t.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("rt_start") - margin), bucket(F.col("rt_end") + margin))))
    x = curves.withColumn("rt", F.col("rt") + F.col(shift) if shift else F.col("rt")).withColumn("_bucket", bucket(F.col("rt")))
    return x.join(t, "_bucket").where(F.col("rt").between(F.col("rt_start") - margin, F.col("rt_end") + margin)).drop("_bucket")


def local_alignment(curves: DataFrame, peaks: DataFrame, p: PeakParams = PeakParams()) -> DataFrame:
    """(peak_id, sample_id, apex, reference_apex, local_shift, capped, max_shift): every sample's highest point in the peak's window is
    brought to the median apex; a larger shift than allowed becomes 0 and is marked."""
    hit = peak_windows(curves, peaks, p.peak_margin_min).groupBy("peak_id", "sample_id").agg(F.max_by("rt", F.struct("value", -F.col("rt"))).alias("_apex"))
    x = peaks.select("peak_id", "rt_apex", "width").crossJoin(F.broadcast(curves.select("sample_id").distinct())).join(hit, ["peak_id", "sample_id"], "left")
    x = x.withColumn("apex", F.coalesce("_apex", "rt_apex"))
    x = x.withColumn("reference_apex", F.median("apex").over(Window.partitionBy("peak_id")))
    most = F.least(lit(p.max_local_shift_cap_min), F.greatest(lit(p.max_local_shift_min), p.max_local_shift_fraction * F.col("width")))
    x = x.withColumn("max_shift", most).withColumn("_d", F.col("reference_apex") - F.col("apex")).withColumn("capped", F.abs("_d") > F.col("max_shift"))
    return x.select("peak_id", "sample_id", "apex", "reference_apex", F.when(F.col("capped"), lit(0)).otherwise(F.col("_d")).alias("local_shift"), "capped", "max_shift")


def cut_bounds(peaks: DataFrame, local: DataFrame, aligned: DataFrame | None = None, margin: float = 0.08) -> DataFrame:
    """(peak_id, sample_id, aligned_start, aligned_end, corrected_start, corrected_end, raw_start, raw_end): a peak's window with margins in
    the aligned frame, less the sample's local shift, and less its global shift (aligned: sample_id, rt_shift) too."""
    x = local.select("peak_id", "sample_id", "local_shift").join(peaks.select("peak_id", "rt_start", "rt_end"), "peak_id")
    x = x.join(aligned.select("sample_id", "rt_shift"), "sample_id", "left") if aligned is not None else x.withColumn("rt_shift", lit(0))
    x = x.withColumn("aligned_start", F.col("rt_start") - margin).withColumn("aligned_end", F.col("rt_end") + margin)
    for side in ("start", "end"):
        x = x.withColumn(f"corrected_{side}", F.col(f"aligned_{side}") - F.col("local_shift")).withColumn(f"raw_{side}", F.col(f"corrected_{side}") - F.coalesce("rt_shift", lit(0)))
    return x.select("peak_id", "sample_id", *[f"{k}_{side}" for k in ("aligned", "corrected", "raw") for side in ("start", "end")])
