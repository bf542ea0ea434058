"""The peak-first comparison of samples, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import tic_peak_status
from scanlake.operators import align as A
from scanlake.operators import compare as C
from scanlake.operators import peaks as K
from scanlake.operators import points as P
from scanlake.operators import series as S
from scanlake.operators.shared import written
from scanlake.schema import PeakParams


def choose_reference(samples: list[str], explicit: str | None = None, preferred: tuple[str, ...] = (), prefix: str | None = None) -> str:
    """The explicit sample, else the first preferred, else the first with the prefix, else the first."""
    if explicit is not None:
        if explicit not in samples:
            raise ValueError(f"unknown reference sample {explicit!r}")
        return explicit
    return next((s for s in preferred if s in samples), next((s for s in samples if prefix and s.startswith(prefix)), samples[0]))


def pinned(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of a row per sample, peak or both as local rows: plans that use it start there. More than `most` rows are written to the shared folder."""
    df = written(df, "pinned")
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if df.count() <= most else df


def peak_first(points: DataFrame, reference: str, p: PeakParams = PeakParams(), order: tuple[str, ...] = ("mz",)) -> dict[str, DataFrame]:
    """alignment, tic_peaks, peak_results, features, feature_groups and global_features of points (sample_id, scan_id, rt, mz, intensity).

    Only tables of a row per sample, peak or m/z bin of a peak come to the driver between steps (pinned); points are read by joins with them.
    Scans, curves and the peaks' spectra stay cached for the results; spark.catalog.clearCache() lets them go.
    """
    scans = P.chromatogram(points).persist()
    tic, bpi = (scans.select("sample_id", "rt", F.col(c).alias("value")) for c in ("tic", "bpi"))
    samples = pinned(scans.select("sample_id").distinct())
    chrom = pinned(K.chromatogram_peaks(bpi, ["sample_id"]))
    aligned = pinned(A.alignment(bpi, chrom, K.main_peaks(bpi, chrom, ["sample_id"]), reference))
    tic = tic.join(aligned, "sample_id").select("sample_id", (F.col("rt") + F.col("rt_shift")).alias("rt"), "value").persist()

    one = K.refine_boundaries(K.tic_peaks(S.consensus(tic, p.consensus_rt_step_min, p.consensus_max_points).withColumn("_g", F.lit(0)), ["_g"], p), ["_g"], p)
    own = K.with_status(K.refine_boundaries(K.tic_peaks(tic, ["sample_id"], p), ["sample_id"], p), p).where("status <> 'noise_peak'")
    merged = K.with_status(K.merge_candidates(one, own, p), p)
    merged = pinned(merged.withColumn("peak_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rt_apex"))))
    none = merged.select("peak_id").crossJoin(F.broadcast(samples)).withColumn("shift", F.lit(0.0))
    bounds = ["peak_id", "rt_start", "rt_apex", "rt_end", "width"]
    tic_peaks = pinned(merged.join(C.selection_scores(tic, merged.select(*bounds), none, p), "peak_id"))
    peaks = pinned(tic_peaks.where("status = 'confirmed_peak'").orderBy(F.desc("tic_selection_score"), F.desc("area"), "peak_id").limit(p.top_n_peaks))
    few = peaks.select(*bounds)

    local = pinned(A.local_alignment(tic, few, p))
    shifts = pinned(local.join(aligned.select("sample_id", "rt_shift"), "sample_id").select("peak_id", "sample_id", (F.col("rt_shift") + F.col("local_shift")).alias("shift")))
    chrom_scores = C.chromatogram_scores(tic, few, local, local.select("peak_id", "sample_id", F.col("local_shift").alias("shift")), p)
    spectra = C.summed_spectra(points, few, shifts, p, order).persist()
    bins = pinned(C.consensus_bins(spectra, p))
    matrix = pinned(C.reduced(C.vectors(spectra, bins, samples, p, order), p))
    kept = matrix.select("peak_id", "bin_index", "bin_mz").distinct()
    apex = C.vectors(C.apex_spectra(points, scans, few, shifts, order), kept, samples, p, order)
    scores = C.spectrum_scores(matrix, apex)
    top = pinned(C.top_changes(C.mz_changes(matrix), p).select("peak_id", "candidate_rank", F.col("bin_mz").alias("target_mz")))
    features = pinned(C.candidate_features(points, scans, top, few, shifts, p))
    groups = pinned(C.peak_feature_groups(features, few, p))
    x = peaks.drop("status").join(chrom_scores, "peak_id").join(scores, "peak_id")
    names = ("chromatogram_score", "spectrum_score", "presence_absence_score", "top_mz_overlap_score", "relative_abundance_score")
    x = x.withColumn("status", tic_peak_status(F.col("capped"), *[F.col(c) for c in names]))
    weights = {"shape_score": 0.15, "area_score": 0.10, "apex_score": 0.05, "width_score": 0.05, "spectrum_score": 0.65}
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(c)
    return {
        "alignment": aligned,
        "tic_peaks": tic_peaks,
        "peak_results": x.withColumn("peak_consistency_score", total),
        "features": features,
        "feature_groups": groups,
        "global_features": C.global_features(groups, p),
    }


def compare(spark, sf_dir: str) -> DataFrame:
    """peak_results of the adapter, A as the reference."""
    from scanlake.plans.catalogue import KEYS, points

    x = peak_first(points(spark, sf_dir), "A", order=KEYS)["peak_results"]
    return x.select("peak_id", "rt_start", "rt_apex", "rt_end", "tic_selection_score", "chromatogram_score", "spectrum_score", "peak_consistency_score", "status")
