"""Saved features, and matrices with columns per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auto_regions(regions: DataFrame, heatmap_id: str, top: int = 80) -> DataFrame:
    """Ranked regions without repeats of (heat map, rt, mz to nine digits), the first `top`, with ids in order."""
    x = regions.withColumn("heatmap_id", F.lit(heatmap_id)).withColumn("_rt", F.bround("rt", 9)).withColumn("_mz", F.bround("mz", 9))
    first = Window.partitionBy("heatmap_id", "_rt", "_mz").orderBy("region_rank")
    x = x.withColumn("_at", F.row_number().over(first)).where("_at = 1")
    x = x.withColumn("source_rank", F.row_number().over(Window.partitionBy("heatmap_id").orderBy("region_rank"))).where(F.col("source_rank") <= top)
    return x.withColumn("region_id", F.format_string("AUTO_%05d", "source_rank")).drop("_at", "_rt", "_mz")


def region_matrix(regions: DataFrame, near: DataFrame, sample_ids: list[str]) -> DataFrame:
    """A row per region with raw, normalised and presence columns of each sample."""
    x = regions.select("region_id", "heatmap_id", "source_rank", "mz_index", "rt_index", "rt", "mz", "difference_type", "weighted_difference_score")
    cells = near.join(x.select("mz_index", "rt_index").distinct(), ["mz_index", "rt_index"])
    agg = [F.max("raw").alias("raw"), F.max("norm").alias("normalized")]
    wide = cells.groupBy("mz_index", "rt_index").pivot("sample_id", sample_ids).agg(*agg)
    out = x.join(wide, ["mz_index", "rt_index"], "left").na.fill(0.0)
    for s in sample_ids:
        out = out.withColumn(f"{s}_present", F.col(f"{s}_raw") > 0)
    return out


def upsert_features(old: DataFrame, new: DataFrame, now, prefix: str = "PF_", keep_created: bool = True) -> DataFrame:
    """Replaces all saved features by new (region_id, feature_id, feature_json, created_at); ids are region_id, else feature_id, else
    prefix and a number in row order (`ord`). A feature that was there keeps its created_at. Rows without JSON are skipped.

    Repeated ids are an error, raised when the result is read.
    """
    x = new.where("try_parse_json(feature_json) IS NOT NULL")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord"))
    x = x.withColumn("id", F.coalesce(F.nullif("region_id", F.lit("")), F.nullif("feature_id", F.lit("")), F.format_string(prefix + "%05d", number)))
    twice = F.count(F.lit(1)).over(Window.partitionBy("id"))
    x = x.withColumn("id", F.when(twice > 1, F.raise_error(F.concat(F.lit("repeated feature id "), F.col("id"))).cast("string")).otherwise(F.col("id")))
    x = x.select(F.col("id").alias("feature_id"), "feature_json", F.col("created_at").alias("_own"))
    x = x.join(old.select("feature_id", F.col("created_at").alias("_old")), "feature_id", "left")
    created = F.coalesce("_old", now) if keep_created else F.coalesce("_own", now)
    return x.select("feature_id", "feature_json", created.alias("created_at"), now.alias("updated_at"))


def feature_matrix(saved: DataFrame, sample_ids: list[str]) -> DataFrame:
    """Six columns per sample from saved features (feature_id, feature_json): raw, normalised, presence, scan and its raw and aligned RT.

    The JSON holds aligned_rt, mz, sample_intensities{sample: raw, normalized}, source_scans{sample: scan_id, raw_rt, aligned_rt}.
    """
    schema = "region_id string, aligned_rt double, rt double, mz double, difference_type string, sample_intensities map<string,struct<raw:double,normalized:double>>, source_scans map<string,struct<scan_id:string,raw_rt:double,aligned_rt:double>>"
    x = saved.withColumn("f", F.from_json("feature_json", schema))
    out = [F.coalesce("f.region_id", "feature_id").alias("feature_id"), F.coalesce("f.aligned_rt", "f.rt").alias("aligned_rt"), F.col("f.mz").alias("mz"), F.col("f.difference_type").alias("difference_type")]
    for s in sample_ids:
        i, t = F.try_element_at("f.sample_intensities", F.lit(s)), F.try_element_at("f.source_scans", F.lit(s))
        raw = F.coalesce(i["raw"], F.lit(0.0))
        out += [raw.alias(f"{s}_raw"), F.coalesce(i["normalized"], F.lit(0.0)).alias(f"{s}_normalized"), F.when(raw > 0, "present").otherwise("missing").alias(f"{s}_status")]
        out += [t["scan_id"].alias(f"{s}_scan_id"), t["raw_rt"].alias(f"{s}_raw_rt"), t["aligned_rt"].alias(f"{s}_aligned_rt")]
    return x.select(*out)
