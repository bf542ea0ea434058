"""Column expressions: tolerances, scores, classifiers and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return F.lit(float(x))


def ppm_window(mz: Column, ppm: float) -> Column:
    return F.abs(mz) * ppm / 1e6


def mz_tolerance(mz: Column, mode: str = "da", ppm: float = 20.0, da: float = 0.5) -> Column:
    return F.greatest(mz * ppm / 1e6, lit(1e-9)) if mode == "ppm" else lit(da)


def ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    """a / b where b > 0."""
    return F.when(b > 0, a / b).otherwise(otherwise if otherwise is None else lit(otherwise))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), lit(0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in 0..1; 0 if either is empty or has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, clamp(dot(a, b) / norms)), lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / (a + b) over non-negative intensities."""
    x, y = F.greatest(a, lit(0)), F.greatest(b, lit(0))
    return clamp(1 - F.abs(x - y) / (x + y + 1e-9))


def cv(x: Column) -> Column:
    """Aggregate: population CV, null where the mean is not positive."""
    return ratio(F.stddev_pop(x), F.avg(x), None)


def cv_of_positives(x: Column) -> Column:
    """Aggregate: population CV of the positive values, null for fewer than two."""
    p = F.when(x > 0, x)
    return F.when(F.count(p) >= 2, ratio(F.stddev_pop(p), F.avg(p), None))


def score_from_cv(x: Column) -> Column:
    """Aggregate: 1 / (1 + CV of the positives); 1 for one positive value, 0 for none."""
    p = F.when(x > 0, x)
    return F.when(F.count(p) == 0, lit(0)).otherwise(1 / (1 + F.coalesce(cv_of_positives(x), lit(0))))


def fold_change(target: Column, reference: Column, floor: float = 1.0) -> Column:
    return F.when((target <= 0) & (reference <= 0), None).otherwise(F.greatest(target, lit(floor)) / F.greatest(reference, lit(floor)))


def group_difference(ref_present: Column, target_present: Column, fc: Column, rt_shifted: Column, threshold: float = 2.0) -> Column:
    """Struct (difference_type, confidence_score) of a feature group."""
    away = F.least(lit(0.95), 0.5 + F.abs(F.log2(fc)) / 6)
    kind = lambda name, score: F.struct(F.lit(name).alias("difference_type"), (score if isinstance(score, Column) else lit(score)).alias("confidence_score"))
    return (
        F.when(rt_shifted & ref_present & target_present, kind("rt_shift", 0.75))
        .when(target_present & ~ref_present, kind("new_feature", 0.9))
        .when(ref_present & ~target_present, kind("missing_feature", 0.9))
        .when(fc >= threshold, kind("increased", away))
        .when(fc <= 1 / threshold, kind("decreased", away))
        .when(ref_present & target_present, kind("common_feature", 0.7))
        .otherwise(kind("uncertain", 0.3))
    )


def pair_difference_type(ref_raw: Column, raw: Column, ref_norm: Column, norm: Column, score: Column) -> Column:
    fold = (norm + 1e-12) / (ref_norm + 1e-12)
    return (
        F.when((ref_raw <= 0) & (raw > 0), "new_signal")
        .when((ref_raw > 0) & (raw <= 0), "missing_signal")
        .when(score > 0.75, "uncertain")
        .when(fold >= 1.5, "intensity_increased")
        .when(fold <= 1 / 1.5, "intensity_decreased")
        .otherwise("uncertain")
    )


def cohort_difference_type(present: Column, samples: Column, fold: Column, score: Column) -> Column:
    """present: samples with raw signal; fold: max / min of the positive normalised values, null for fewer than two."""
    return (
        F.when((present > 0) & (present < samples), "new_signal")
        .when(score > 0.75, "uncertain")
        .when(fold >= 1.5, "intensity_increased")
        .otherwise("uncertain")
    )


def signal_status(present: Column, samples: Column) -> Column:
    return F.when(present == 0, "low_signal_background").when(present < samples, "presence_absence").otherwise("high_confidence")


def tic_peak_status(capped: Column, chrom: Column, spectrum: Column, presence: Column, overlap: Column, relative: Column) -> Column:
    return (
        F.when(capped, "possible_rt_shift")
        .when((chrom >= 0.9) & (spectrum >= 0.9) & (presence >= 0.9), "high_consistency")
        .when((chrom >= 0.9) & (spectrum < 0.85), "chromatogram_consistent_spectrum_changed")
        .when(chrom < 0.85, "chromatogram_changed")
        .when((spectrum < 0.85) | (overlap < 0.8) | (presence < 0.85) | (relative < 0.8), "need_local_rt_mz_analysis")
        .otherwise("moderate_consistency")
    )


def feature_group_difference(positive: Column, matched: Column, samples: Column, score: Column) -> Column:
    return (
        F.when((matched == 0) | (positive == 0), "low_confidence")
        .when(matched < samples, "presence_absence")
        .when(score < 0.6, "area_changed")
        .when(score < 0.8, "moderate_difference")
        .otherwise("common_feature")
    )


def join_match_score(mz_delta: Column, mz_tol: Column, rt_delta: Column, rt_tol: float = 0.12, mz_weight: float = 0.7, rt_weight: float = 0.3) -> Column:
    """Weighted closeness in m/z and RT; a missing RT (null delta) scores 0 there."""
    near = lambda d, tol: F.greatest(lit(0), 1 - d / F.greatest(tol, lit(1e-9)))
    return (mz_weight * near(mz_delta, mz_tol) + rt_weight * near(F.coalesce(rt_delta, lit(rt_tol)), lit(rt_tol))) / max(mz_weight + rt_weight, 1e-9)


def directional_difference(score: Column, sample: Column, reference: Column) -> Column:
    """1 - score, negative where the sample is below the reference."""
    return F.when(sample >= reference, 1 - score).otherwise(score - 1)


def feature_map_priority(low: Column, rank: Column) -> Column:
    return 0.78 * low + 0.22 * F.sqrt(rank)


def sample_from_file_name(name: Column, products: tuple[str, ...] = ()) -> Column:
    """Sample id of a file name: without suffix and -metadata; <product>_<last part> where it holds a product."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "-metadata", "")
    out = stem
    for p in reversed(products):
        out = F.when(F.contains(stem, F.lit(p)), F.concat(F.lit(p + "_"), F.element_at(F.split(stem, "_"), -1))).otherwise(out)
    return out


def heatmap_identifier(key: Column, method: Column) -> Column:
    return F.concat(key, F.lit(":"), method)


def comparison_spec(spec: str) -> dict[str, str]:
    """id|label|directory, or id|directory, or a directory alone; the id keeps letters, digits, _ and - only."""
    import re

    parts = [x.strip() for x in spec.split("|", 2)]
    if not parts[-1]:
        raise ValueError(f"no directory in {spec!r}")
    name = parts[0] if len(parts) > 1 else parts[0].rstrip("/").rpartition("/")[2]
    safe = re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "comparison"
    return {"id": safe, "label": parts[1] if len(parts) == 3 and parts[1] else name, "directory": parts[-1]}
