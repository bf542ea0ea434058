"""Schemas of the engine's tables and the tunables of the peak-first comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, D, I, L, B = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType()
SCAN = _struct(
    scan_id=S, raw_file_id=S, sample_id=S, rt=D, ms_level=I, mz_array=ArrayType(D, False), intensity_array=ArrayType(D, False),
    tic=D, base_peak_mz=D, base_peak_intensity=D, sample_ord=I, scan_ord=I,
)
RAW_FILE = _struct(
    raw_file_id=S, sample_id=S, project_id=S, file_name=S, file_path=S, data_format=S, mz_min=D, mz_max=D, rt_min=D, rt_max=D, scan_count=L, parser_status=S
)
POINT = _struct(sample_id=S, scan_id=S, rt=D, mz=D, intensity=D)
TIC_PEAK = _struct(
    rt_rank=I, area_rank=I, rt_start=D, rt_apex=D, rt_end=D, height=D, body_height=D, area=D, width=D, prominence=D, snr=D, area_ratio=D, noise_level=D
)
CHROM_PEAK = _struct(start_time_min=D, apex_time_min=D, end_time_min=D, height=D, area=D, width_min=D, baseline=D, area_rank=I)
FEATURE = _struct(rt_start=D, rt_apex=D, rt_end=D, area=D, height=D, signal_to_noise=D, area_rank=I)
LANDMARK = _struct(reference_rt=D, sample_rt=D, rt_shift=D, reference_area=D, sample_area=D)
FEATURE_GROUP = _struct(
    feature_group_id=S, representative_mz=D, representative_rt=D, sample_count=I, missing_sample_count=I, cv=D, max_fold_change=D,
    difference_type=S, confidence_score=D, sample_presence=MapType(S, B), area_by_sample=MapType(S, D),
)
SAVED_FEATURE = _struct(feature_id=S, feature_json=S, created_at=S, updated_at=S)


@dataclass(frozen=True)
class PeakParams:
    """The defaults of the peak-first comparison."""

    smoothing_window: int = 3
    baseline_window: int = 41
    min_snr: float = 5.0
    min_prominence_factor: float = 3.0
    min_area: float = 0.0
    min_area_ratio: float = 0.00001
    min_width: float = 0.03
    max_width: float = 3.0
    min_apex_distance_min: float = 0.02
    peak_boundary_fraction: float = 0.08
    peak_body_smoothing_window: int = 11
    min_valley_depth_fraction: float = 0.05
    shoulder_merge_gap_min: float = 0.30
    shoulder_merge_valley_depth_fraction: float = 0.35
    max_local_shift_min: float = 0.1
    max_local_shift_fraction: float = 0.2
    max_local_shift_cap_min: float = 0.5
    continuous_peak_gap_min: float = 0.08
    isolated_peak_edge_extension_min: float = 0.03
    tic_difference_selection_weight: float = 1.5
    xic_feature_search_margin_min: float = 0.45
    feature_drift_tolerance_min: float = 0.35
    mz_tolerance_ppm: float = 20.0
    mz_tolerance_da: float = 0.5
    mz_tolerance_mode: str = "da"
    top_n_mz: int = 50
    top_n_changed_mz: int = 20
    min_changed_mz_gap_da: float = 1.0
    top_n_peaks: int = 60
    max_spectrum_points_per_scan: int = 200
    min_relative_intensity: float = 0.001
    resample_points: int = 100
    peak_margin_min: float = 0.08
    consensus_rt_step_min: float = 0.01
    consensus_max_points: int = 8000
    xic_context_min: float = 3.0
    feature_rt_tolerance_min: float = 0.12
    feature_mz_weight: float = 0.7
    feature_rt_weight: float = 0.3
    feature_min_height_fraction: float = 0.02
    feature_gap_fill_height_fraction: float = 0.005
    feature_abundance_weight: float = 0.8
    global_feature_rt_merge_tolerance_min: float = 0.8
    global_feature_mz_merge_tolerance_factor: float = 2.0
