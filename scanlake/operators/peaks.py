"""Peak detection. What feeds and follows the peaks are window plans; the peaks of a curve are found in stretches between quiet points, so that
a long curve is many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scanlake.functions import lit
from scanlake.operators.series import baseline, noise_level, padded_average, robust_noise, trapezoids
from scanlake.operators.shared import islands, written
from scanlake.schema import CHROM_PEAK, FEATURE, TIC_PEAK, PeakParams


def per_curve(df: DataFrame, by: list[str], quiet: Column, away: Column, schema, find, rows: int) -> DataFrame:
    """Applies find(rt-ordered frame) -> tuples of schema to each curve, in tasks of about `rows` neighbouring points.

    A peak ends at a quiet point at the latest, and peaks with `away` quiet points in a row between them have nothing to do with each other, so curves are
    cut within such rows, each side keeping a quiet point; a curve without them stays whole. find gets what it needs of the whole curve as columns.
    """
    line = Window.partitionBy(*by).orderBy("rt")
    x = df.withColumn("_q", quiet).withColumn("_i", F.row_number().over(line))
    x = x.withColumn("_new", F.coalesce(F.lag("_q").over(line) != F.col("_q"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(line))
    run = Window.partitionBy(*by, "_run")
    j = F.col("_i") - F.min("_i").over(run)
    cut = F.col("_q") & (F.count(F.lit(1)).over(run) >= F.greatest(away, F.lit(2))) & ((j == 1) | ((j > 0) & (j % rows == 0)))
    x = x.withColumn("_part", F.sum(cut.cast("int")).over(line))
    x = x.withColumn("_task", F.floor(F.min("_i").over(Window.partitionBy(*by, "_part")) / rows)).drop("_q", "_i", "_new", "_run", "_part")
    keys = [df.schema[k] for k in by]
    names = [f.name for f in schema]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(find(part.sort_values("rt", kind="stable", ignore_index=True)), columns=names)
        for i, k in enumerate(by):
            out.insert(i, k, part[k].iloc[0])
        return out

    return x.groupBy(*by, "_task").applyInPandas(one, StructType([*keys, *schema]))


def feet(y: np.ndarray, apex: int, level: float) -> tuple[int, int]:
    """The nearest points to either side of apex, itself included, that are not above level; else the ends."""
    low = np.flatnonzero(y <= level)
    left, right = low[low <= apex], low[low >= apex]
    return int(left[-1]) if len(left) else 0, int(right[0]) if len(right) else len(y) - 1


def steps(rt: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cumulative trapezoid area up to each point."""
    return np.concatenate([[0.0], np.cumsum((y[1:] + y[:-1]) / 2 * np.maximum(np.diff(rt), 0))]) if len(y) else np.zeros(0)


def apart(order: np.ndarray, gap: int, n: int) -> np.ndarray:
    """Indexes kept from order (strongest first) so that no two lie within gap; sorted."""
    free, kept = np.ones(n, bool), []
    for i in order:
        if free[i]:
            kept.append(i)
            free[max(0, i - gap) : i + gap + 1] = False
    return np.sort(np.array(kept, int))


def find_tic_peaks(rows: pd.DataFrame, p: PeakParams) -> list[tuple]:
    rt, y, body = rows["rt"].to_numpy(), rows["corrected"].to_numpy(), rows["body_corrected"].to_numpy()
    noise, near, whole = float(rows["noise_level"].iloc[0]), int(rows["_near"].iloc[0]), float(rows["_total"].iloc[0])
    n = len(rt)
    if n < 3:
        return []
    total = steps(rt, y)
    inner = np.arange(1, n - 1)
    tops = inner[(body[1:-1] >= max(noise * p.min_snr, 1e-9)) & (body[1:-1] >= body[:-2]) & (body[1:-1] >= body[2:])]
    tops = apart(tops[np.argsort(-body[tops], kind="stable")], near, n)
    # neighbours without a real valley between them are one peak
    apexes: list[int] = []
    for i in tops.tolist():
        if apexes:
            j = apexes[-1]
            low = min(body[i], body[j])
            depth = (low - body[j : i + 1].min()) / low if low > 0 else 0.0
            if depth < p.min_valley_depth_fraction or (rt[i] - rt[j] <= p.shoulder_merge_gap_min and depth < p.shoulder_merge_valley_depth_fraction):
                if body[i] > body[j]:
                    apexes[-1] = i
                continue
        apexes.append(i)
    valleys = [int(a + np.argmin(body[a : b + 1])) for a, b in zip(apexes, apexes[1:])]
    found = []
    for k, i in enumerate(apexes):
        left, right = feet(body, i, max(noise, body[i] * p.peak_boundary_fraction))
        left = max(left, valleys[k - 1]) if k else left
        right = min(right, valleys[k]) if k < len(valleys) else right
        if right <= left:
            continue
        top = int(left + np.argmax(body[left : right + 1]))
        size = total[right] - total[left]
        found.append((rt[left], rt[top], rt[right], y[top], body[top], size, rt[right] - rt[left], max(body[top] - max(body[left], body[right]), 0.0), body[top] / noise if noise > 0 else 0.0, size / whole if whole > 0 else 0.0, noise))
    return found


def ranked(peaks: DataFrame, by: list[str], area: str, first: list) -> DataFrame:
    """Adds area_rank by falling area; of equal ones the first by `first`."""
    return peaks.withColumn("area_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(area), *first)))


def tic_peaks(curves: DataFrame, by: list[str], p: PeakParams = PeakParams(), rows: int = 1 << 17) -> DataFrame:
    """(by.., TIC_PEAK) of curves (by.., rt, value). rows: see per_curve."""
    x = baseline(curves.select(*by, "rt", F.col("value").cast("double").alias("value")), by, p.smoothing_window, p.baseline_window, p.peak_body_smoothing_window)
    x = x.join(noise_level(x, by), by)
    every, gap = Window.partitionBy(*by), F.col("rt") - F.lag("rt").over(Window.partitionBy(*by).orderBy("rt"))
    x = x.withColumn("_gap", gap).withColumn("_area", trapezoids("corrected", by))
    x = x.withColumn("_total", F.coalesce(F.sum("_area").over(every), lit(0))).withColumn("_step", F.coalesce(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).over(every), lit(0.01)))
    x = x.withColumn("_near", F.greatest(F.lit(1), (p.min_apex_distance_min / F.greatest("_step", lit(1e-9))).cast("int")))
    quiet = F.col("body_corrected") <= F.col("noise_level") if p.min_snr > 1 else F.lit(False)
    found = per_curve(x.drop("_gap", "_area", "_step"), by, quiet, F.col("_near") + 2, TIC_PEAK.fields[2:], lambda part: find_tic_peaks(part, p), rows)
    found = ranked(found, by, "area", ["rt_apex", "rt_start"])
    return found.withColumn("rt_rank", F.row_number().over(Window.partitionBy(*by).orderBy("rt_apex", "area_rank"))).select(*by, *TIC_PEAK.names)


def refine_boundaries(peaks: DataFrame, by: list[str], p: PeakParams = PeakParams()) -> DataFrame:
    """Neighbours nearly touching share a boundary; the others reach out a little into the gap. Windows over apex order."""
    line = Window.partitionBy(*by).orderBy("rt_apex")
    cont, ext = p.continuous_peak_gap_min, p.isolated_peak_edge_extension_min
    nxt, prv = (lambda c: F.lead(c).over(line)), (lambda c: F.lag(c).over(line))

    def shared(end, start, left_apex, right_apex):
        return F.when(start - end < 0, (left_apex + right_apex) / 2).otherwise((end + start) / 2)

    gap_next, gap_prev = nxt("rt_start") - F.col("rt_end"), F.col("rt_start") - prv("rt_end")
    end = F.when(gap_next <= cont, F.least(shared(F.col("rt_end"), nxt("rt_start"), F.col("rt_apex"), nxt("rt_apex")), nxt("rt_apex"))).otherwise(F.col("rt_end"))
    start = F.when(gap_prev <= cont, F.greatest(shared(prv("rt_end"), F.col("rt_start"), prv("rt_apex"), F.col("rt_apex")), prv("rt_apex"))).otherwise(F.col("rt_start"))
    x = peaks.withColumn("_end", end).withColumn("_start", start)
    gap = nxt("_start") - F.col("_end")
    x = x.withColumn("_out", F.when(nxt("_start").isNull(), F.col("_end") + ext).when(gap > cont, F.col("_end") + F.least(lit(ext), gap * 0.4)).otherwise(F.col("_end")))
    gap = F.col("_start") - prv("_out")
    x = x.withColumn("_in", F.when(prv("_out").isNull(), F.greatest(lit(0), F.col("_start") - ext)).when(gap > cont, F.col("_start") - F.least(lit(ext), gap * 0.4)).otherwise(F.col("_start")))
    return x.withColumn("rt_start", F.col("_in")).withColumn("rt_end", F.col("_out")).withColumn("width", F.greatest(F.col("_out") - F.col("_in"), lit(0))).drop("_end", "_start", "_out", "_in")


def with_status(peaks: DataFrame, p: PeakParams = PeakParams()) -> DataFrame:
    """Adds status: noise_peak, weak_peak or confirmed_peak."""
    c = F.col
    noise = (c("snr") < max(2.0, p.min_snr * 0.6)) | (c("width") < p.min_width * 0.5)
    weak = (c("snr") < p.min_snr) | (c("prominence") < c("noise_level") * p.min_prominence_factor) | (c("area") < p.min_area) | (c("area_ratio") < p.min_area_ratio) | ~c("width").between(p.min_width, p.max_width)
    return peaks.withColumn("status", F.when(noise, "noise_peak").when(weak, "weak_peak").otherwise("confirmed_peak"))


def merge_candidates(consensus: DataFrame, samples: DataFrame, p: PeakParams = PeakParams()) -> DataFrame:
    """Union of consensus peaks and samples' peaks (sample_id), merged where apexes are near: the larger shape stays, bounds widen, the
    samples that support it are listed.

    A representative changes as it grows, but its apex is always one of its members', and nothing joins over more than the widest
    reach there can be: apexes across a wider gap cannot meet, directly or through others, and are folded apart.
    """
    shape = ["height", "body_height", "area", "width", "prominence", "snr", "area_ratio", "noise_level"]
    cols = ["rt_start", "rt_apex", "rt_end", *shape]
    both = consensus.select(*cols, F.lit("consensus_tic").alias("source"), F.lit(None).cast("string").alias("sample_id"), F.lit(0).alias("_o"))
    both = both.unionByName(samples.select(*cols, F.lit("sample_tic").alias("source"), "sample_id", F.lit(1).alias("_o")))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_a=-rows["area"]).sort_values(["rt_apex", "_a", "_o", "sample_id"], kind="stable", na_position="first")
        reps: list[dict] = []
        for x in rows.drop(columns=["_a", "_o", "_part"]).to_dict("records"):
            who = {x.pop("sample_id")} - {None}
            near = max(2 * p.min_apex_distance_min, min(p.max_local_shift_min, 0.35 * max(x["width"], p.min_width)))
            rep = next((r for r in reps if abs(r["rt_apex"] - x["rt_apex"]) <= near), None)
            if rep is None:
                reps.append(x | {"supporting_samples": who})
                continue
            low, high = min(rep["rt_start"], x["rt_start"]), max(rep["rt_end"], x["rt_end"])
            if x["area"] > rep["area"]:
                low, high = x["rt_start"], x["rt_end"]
                rep.update({k: x[k] for k in ["rt_apex", *shape] if k != "noise_level"})
            rep.update(rt_start=low, rt_end=high, supporting_samples=rep["supporting_samples"] | who)
            if x["source"] == "consensus_tic":
                rep["source"] = "consensus_tic"
        for r in reps:
            r["supporting_samples"] = sorted(r["supporting_samples"])
        return pd.DataFrame(reps, columns=[*cols, "source", "supporting_samples"])

    schema = ", ".join(f"{c} double" for c in cols) + ", source string, supporting_samples array<string>"
    widest = max(2 * p.min_apex_distance_min, p.max_local_shift_min)
    both = written(both, "candidates")
    bin_ = F.floor(F.col("rt_apex") / (widest / 2)).cast("long")
    cuts = islands(both, [], "rt_apex", bin_, lit(widest)).select("_bin", F.col("island").alias("_part"))
    parts = both.withColumn("_bin", bin_).join(cuts, "_bin").drop("_bin")
    merged = parts.groupBy("_part").applyInPandas(merge, schema)
    return refine_boundaries(merged.withColumn("_g", F.lit(0)), ["_g"], p).drop("_g")


def find_chromatogram_peaks(rows: pd.DataFrame) -> list[tuple]:
    rt, raw, c = rows["rt"].to_numpy(), rows["value"].to_numpy(float), rows["_c"].to_numpy()
    base, most, noise = (float(rows[k].iloc[0]) for k in ("_base", "_most", "_noise"))
    if len(rt) < 3 or most <= 0:
        return []
    tops = np.arange(1, len(c) - 1)[(c[1:-1] >= max(4 * noise, 0.08 * most)) & (c[1:-1] >= c[:-2]) & (c[1:-1] > c[2:])]
    total, out = steps(rt, c), []
    for i in tops.tolist():
        left, right = feet(c, i, max(1.8 * noise, 0.025 * c[i]))
        size = total[right] - total[left]
        if rt[right] - rt[left] > 0.02 and size > 0:
            top = int(left + np.argmax(raw[left : right + 1]))
            out.append((rt[left], rt[top], rt[right], raw[top], size, rt[right] - rt[left], base))
    return out


def chromatogram_peaks(curves: DataFrame, by: list[str], rows: int = 1 << 17) -> DataFrame:
    """(by.., CHROM_PEAK): peaks of padded 7-point averages over the 10% quantile, by falling area. rows: see per_curve."""
    every = Window.partitionBy(*by)
    x = padded_average(curves.select(*by, "rt", F.col("value").cast("double").alias("value")), "value", 7, by, "_y")
    x = x.withColumn("_base", F.expr("percentile(_y, 0.1)").over(every)).withColumn("_c", F.greatest(F.col("_y") - F.col("_base"), lit(0)))
    x = x.withColumn("_most", F.max("_c").over(every)).withColumn("_noise", F.greatest(F.expr("percentile(_c, 0.25)").over(every), F.col("_most") * 0.01, lit(1)))
    found = per_curve(x.drop("_y"), by, F.col("_c") <= 1.8 * F.col("_noise"), F.lit(2), CHROM_PEAK.fields[:-1], find_chromatogram_peaks, rows)
    return ranked(found, by, "area", ["apex_time_min", "start_time_min"])


def main_peaks(curves: DataFrame, peaks: DataFrame, by: list[str]) -> DataFrame:
    """(by.., start, apex, end, height, area, match_method): the largest peak, or the highest point of a curve without one."""
    cols = ["start_time_min", "apex_time_min", "end_time_min", "height", "area"]
    first = peaks.where("area_rank = 1").select(*by, *cols, F.lit("largest_area").alias("match_method"))
    line = Window.partitionBy(*by).orderBy("rt")
    x = curves.withColumn("_l", F.coalesce(F.lag("rt").over(line), "rt")).withColumn("_r", F.coalesce(F.lead("rt").over(line), "rt"))
    top = x.groupBy(*by).agg(F.max_by(F.struct("_l", "rt", "_r", "value"), F.struct("value", -F.col("rt"))).alias("t"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    rest = top.join(first.select(*by), by, "left_anti").select(*by, "t._l", "t.rt", "t._r", "t.value", F.col("t.value").alias("_a"), F.lit("fallback_max_point"))
    return first.unionByName(rest.toDF(*by, *cols, "match_method"))


def find_xic_peaks(rows: pd.DataFrame, least_height: float, least_area: float, least_snr: float, least_width: float, most_width: float, foot: float) -> list[tuple]:
    rt, raw, y, noise = rows["rt"].to_numpy(), rows["value"].to_numpy(float), rows["smoothed"].to_numpy(), float(rows["noise"].iloc[0])
    if len(rt) < 3:
        return []
    mid = y[1:-1]
    tops = np.arange(1, len(y) - 1)[(mid >= y[:-2]) & (mid > y[2:]) & (mid >= least_height) & (mid / noise >= least_snr)]
    used, out = np.zeros(len(y), bool), []
    for i in tops[np.argsort(-y[tops], kind="stable")].tolist():
        left, right = feet(y, i, max(2 * noise, y[i] * foot))
        if used[left : right + 1].any() or not least_width <= rt[right] - rt[left] <= most_width:
            continue
        part = np.maximum(raw[left : right + 1] - min(raw[left], raw[right]), 0)
        size = steps(rt[left : right + 1], part)[-1]
        if size >= least_area:
            used[left : right + 1] = True
            out.append((rt[left], rt[i], rt[right], size, part.max(), part.max() / noise, y[i]))
    return out


def xic_peaks(xics: DataFrame, by: list[str], smoothing: int = 5, least_height: float = 2000.0, least_area: float = 100.0, least_snr: float = 3.0, least_width: float = 0.03, most_width: float = 1.0, foot: float = 0.05, rows: int = 1 << 17) -> DataFrame:
    """(by.., FEATURE): peaks of XIC curves (by.., rt, value), strongest first without overlap, by falling area. rows: see per_curve."""
    x = padded_average(xics.select(*by, "rt", "value"), "value", smoothing, by, "smoothed")
    x = x.join(robust_noise(x, "smoothed", by), by)
    quiet = F.col("smoothed") <= 2 * F.col("noise") if least_snr > 2 else F.lit(False)  # no top is quiet
    find = lambda part: find_xic_peaks(part, least_height, least_area, least_snr, least_width, most_width, foot)
    found = per_curve(x, by, quiet, F.lit(2), [*FEATURE.fields[:-1], StructField("_top", DoubleType())], find, rows)
    return ranked(found, by, "area", [F.desc("_top"), "rt_apex"]).drop("_top")  # of equal areas the stronger one was found first


def xic_features(xics: DataFrame, by: list[str], p: PeakParams = PeakParams()) -> DataFrame:
    """One feature per curve (by.., rt, value, observed_mz, target_mz): the highest point and its feet, as windows and aggregates.

    match_status is matched, or gap_filled where the top is under 3 noise levels.
    """
    every, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("rt")
    x = xics.withColumn("i", F.row_number().over(line))
    q = x.groupBy(*by).agg(
        F.expr("percentile(value, 0.4)").alias("_q4"), F.expr("percentile(value, 0.1)").alias("_q1"), F.max("value").alias("height"),
        F.max_by("i", F.struct("value", -F.col("i"))).alias("apex"), F.max("i").alias("_n"),
    )
    x = x.join(q, by)
    x = x.withColumn("_low", F.median(F.when(F.col("value") <= F.col("_q4"), F.col("value"))).over(every))
    x = x.withColumn("noise", F.greatest(F.coalesce("_low", lit(0)), F.col("_q1"), lit(1e-9)))
    x = x.withColumn("detected", F.col("height") >= F.greatest(F.col("noise") * 3, F.col("height") * p.feature_min_height_fraction))
    level = F.greatest(F.col("noise"), F.col("height") * F.when(F.col("detected"), lit(p.feature_min_height_fraction)).otherwise(lit(p.feature_gap_fill_height_fraction)))
    under = F.col("value") <= level
    x = x.withColumn("_l", F.coalesce(F.max(F.when(under & (F.col("i") <= F.col("apex")), F.col("i"))).over(every), F.lit(1)))
    x = x.withColumn("_r", F.coalesce(F.min(F.when(under & (F.col("i") >= F.col("apex")), F.col("i"))).over(every), F.col("_n")))
    flat = F.col("_r") <= F.col("_l")
    x = x.withColumn("left", F.when(flat, F.greatest(F.lit(1), F.col("apex") - 1)).otherwise(F.col("_l"))).withColumn("right", F.when(flat, F.least(F.col("_n"), F.col("apex") + 1)).otherwise(F.col("_r")))
    x = x.withColumn("_a", trapezoids("value", by)).where("i BETWEEN left AND right")
    at = lambda k: F.max(F.when(F.col("i") == F.col(k), F.col("rt")))
    heavy = F.sum(F.col("observed_mz") * F.col("value")) / F.nullif(F.sum("value"), lit(0))
    return x.groupBy(*by).agg(
        F.coalesce(heavy, F.max("target_mz")).alias("mz"), at("left").alias("rt_start"), at("apex").alias("rt_apex"), at("right").alias("rt_end"),
        F.sum(F.when(F.col("i") > F.col("left"), F.col("_a")).otherwise(lit(0))).alias("area"), F.max("height").alias("height"),
        (F.max("height") / F.max("noise")).alias("signal_to_noise"), F.when(F.max("detected"), "matched").otherwise("gap_filled").alias("match_status"),
    )
