"""The engine's operators against plain loops and hand-worked cases."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanlake.operators import align as A
from scanlake.operators import compare as C
from scanlake.operators import grid as G
from scanlake.operators import match as M
from scanlake.operators import peaks as K
from scanlake.operators import points as P
from scanlake.operators import series as S
from scanlake.plans import matrices
from scanlake.plans.peak_first import choose_reference, peak_first
from scanlake.schema import PeakParams

PP = PeakParams()


def gauss(x, c, w, h):
    return h * math.exp(-0.5 * ((x - c) / w) ** 2)


def curve(spark, values, step=0.1, sample="A", start=0.0):
    return spark.createDataFrame([(sample, start + step * i, float(v)) for i, v in enumerate(values)], "sample_id string, rt double, value double")


def three_peaks(spark):
    x = [0.01 * i for i in range(401)]
    return curve(spark, [gauss(t, 1.0, 0.04, 1000) + gauss(t, 1.22, 0.04, 850) + gauss(t, 1.55, 0.04, 900) + 10 for t in x], 0.01)


def test_averages(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 100, 30).tolist()
    df = curve(spark, v)
    for w in (1, 2, 5, 7):
        r = max(1, w // 2)
        want = [float(v[i]) if w <= 1 else statistics.mean(v[max(0, i - r) : i + r + 1]) for i in range(30)]
        assert [x[0] for x in S.moving_average(df, "value", w, ["sample_id"], "o").orderBy("rt").select("o").collect()] == pytest.approx(want)
        r = w // 2
        pad = [v[0]] * r + v + [v[-1]] * r
        want = [sum(pad[i : i + 2 * r + 1]) / (2 * r + 1) for i in range(30)]
        assert [x[0] for x in S.padded_average(df, "value", w, ["sample_id"], "o").orderBy("rt").select("o").collect()] == pytest.approx(want)
    assert S.padded_average(curve(spark, [1, 5]), "value", 7, ["sample_id"], "o").agg(F.max("o")).first()[0] == 5


def test_resample(spark):
    x = S.resample(curve(spark, [0, 10, 0, 20], 1.0), 7, ["sample_id"]).orderBy("point").collect()
    assert [r["value"] for r in x] == pytest.approx([0, 5, 10, 5, 0, 10, 20])
    assert [r["value"] for r in S.resample(curve(spark, [4]), 3, ["sample_id"]).collect()] == [4, 4, 4]


def test_tic_peaks_split_at_valleys(spark):
    p = K.with_status(K.refine_boundaries(K.tic_peaks(three_peaks(spark), ["sample_id"]), ["sample_id"]))
    rows = p.where("status = 'confirmed_peak'").orderBy("rt_apex").collect()
    assert len(rows) >= 3 and all(r["width"] < 0.4 for r in rows)
    assert [round(r["rt_apex"], 1) for r in rows] == [1.0, 1.2, 1.5] or [r["rt_apex"] for r in rows] == pytest.approx([1.0, 1.22, 1.55], abs=0.03)
    assert all(a["rt_end"] <= b["rt_start"] + 1e-9 for a, b in zip(rows, rows[1:]))


def test_tic_peaks_ranks_and_short_curves(spark):
    rows = K.tic_peaks(three_peaks(spark), ["sample_id"]).collect()
    assert sorted(r["rt_rank"] for r in rows) == list(range(1, len(rows) + 1)) == sorted(r["area_rank"] for r in rows)
    assert K.tic_peaks(curve(spark, [1, 2]), ["sample_id"]).count() == 0


def test_apart_is_greedy():
    rng = np.random.default_rng(1)
    for _ in range(50):
        order = rng.permutation(40)[:25]
        kept = []
        for i in order:
            if all(abs(i - k) > 3 for k in kept):
                kept.append(i)
        assert K.apart(order, 3, 40).tolist() == sorted(kept)


def test_feet_walk():
    rng = np.random.default_rng(2)
    for _ in range(100):
        y = rng.random(20)
        i, level = int(rng.integers(20)), rng.random()
        a = b = i
        while a > 0 and y[a] > level:
            a -= 1
        while b < 19 and y[b] > level:
            b += 1
        assert K.feet(y, i, level) == (a, b)


def test_refine_boundaries_loop(spark):
    rng = np.random.default_rng(3)
    cut = np.sort(rng.random((12, 3)) * 0.3, axis=1) + np.cumsum(rng.random(12) * 0.35)[:, None]
    rows = [tuple(map(float, r)) for r in cut]
    rows.sort(key=lambda r: r[1])
    got = K.refine_boundaries(spark.createDataFrame([("A", *r, 0.0) for r in rows], "g string, rt_start double, rt_apex double, rt_end double, width double"), ["g"]).orderBy("rt_apex").collect()
    s, a, e = map(list, zip(*rows))
    s1, e1 = s[:], e[:]
    for i in range(11):
        gap = s[i + 1] - e[i]
        if gap <= 0.08:
            mid = (a[i] + a[i + 1]) / 2 if gap < 0 else (e[i] + s[i + 1]) / 2
            e1[i], s1[i + 1] = min(mid, a[i + 1]), max(mid, a[i])
    e2 = [e1[i] + 0.03 if i == 11 else e1[i] + min(0.03, 0.4 * (s1[i + 1] - e1[i])) if s1[i + 1] - e1[i] > 0.08 else e1[i] for i in range(12)]
    s2 = [max(0, s1[i] - 0.03) if i == 0 else s1[i] - min(0.03, 0.4 * (s1[i] - e2[i - 1])) if s1[i] - e2[i - 1] > 0.08 else s1[i] for i in range(12)]
    assert [r["rt_start"] for r in got] == pytest.approx(s2) and [r["rt_end"] for r in got] == pytest.approx(e2)


def test_status_order(spark):
    rows = [(2.0, 1, 1, 1.0, 0.1, 0.5), (4.0, 100.0, 1.0, 5.0, 0.1, 0.5), (9.0, 100.0, 1.0, 5.0, 0.1, 0.5), (9.0, 100.0, 1.0, 5.0, 0.1, 0.01), (9.0, 100.0, 1.0, 5.0, 0.1, 9.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "snr double, prominence double, noise_level double, area double, area_ratio double, width double")
    assert [r["status"] for r in K.with_status(df).collect()] == ["noise_peak", "weak_peak", "confirmed_peak", "noise_peak", "weak_peak"]


def test_merge_candidates(spark):
    cols = "rt_start double, rt_apex double, rt_end double, height double, body_height double, area double, width double, prominence double, snr double, area_ratio double, noise_level double"
    row = lambda a, area: (a - 0.1, a, a + 0.1, 1.0, 1.0, area, 0.2, 1.0, 9.0, 0.1, 1.0)
    one = spark.createDataFrame([row(1.0, 10.0), row(3.0, 10.0)], cols)
    own = spark.createDataFrame([(*row(1.03, 20.0), "B"), (*row(1.02, 5.0), "A"), (*row(2.0, 7.0), "A")], cols + ", sample_id string")
    got = K.merge_candidates(one, own).orderBy("rt_apex").collect()
    assert [(r["rt_apex"], r["source"], r["supporting_samples"]) for r in got] == [(1.03, "consensus_tic", ["A", "B"]), (2.0, "sample_tic", ["A"]), (3.0, "consensus_tic", [])]
    assert got[0]["area"] == 20


def test_chromatogram_and_main_peaks(spark):
    v = [gauss(0.1 * i, 5.0, 0.18, 1000) + gauss(0.1 * i, 8.0, 0.18, 350) + 5 for i in range(121)]
    c = curve(spark, v)
    p = K.chromatogram_peaks(c, ["sample_id"]).orderBy("area_rank").collect()
    assert [r["apex_time_min"] for r in p] == pytest.approx([5.0, 8.0]) and p[0]["height"] == pytest.approx(max(v))
    flat = curve(spark, [3, 3, 7, 3], sample="F")
    both = c.unionByName(flat)
    m = {r["sample_id"]: r for r in K.main_peaks(both, K.chromatogram_peaks(both, ["sample_id"]), ["sample_id"]).collect()}
    assert m["A"]["match_method"] == "largest_area" and (m["F"]["match_method"] == "fallback_max_point") == (m["F"]["area"] == 7.0)


def test_alignment_by_landmarks(spark):
    def v(main, other, h):
        return [gauss(0.1 * i, main, 0.18, 1000) + gauss(0.1 * i, other, 0.18, h) + 5 for i in range(121)]

    c = curve(spark, v(5.0, 8.0, 350)).unionByName(curve(spark, v(5.4, 8.4, 1500), sample="B"))
    p = K.chromatogram_peaks(c, ["sample_id"])
    got = {r["sample_id"]: r for r in A.alignment(c, p, K.main_peaks(c, p, ["sample_id"]), "A", 1.0).collect()}
    assert got["A"]["rt_shift"] == 0 and got["B"]["rt_shift"] == pytest.approx(-0.4, abs=0.11)
    assert got["B"]["landmark_count"] == 2 and got["B"]["match_method"] == "multi_peak_landmark_median"


def test_landmarks_are_one_to_one(spark):
    rows = [("A", 1.0, 9.0, 1), ("A", 1.2, 8.0, 2), ("B", 1.1, 5.0, 1), ("B", 1.9, 4.0, 2), ("B", 9.0, 1.0, 3)]
    p = spark.createDataFrame(rows, "sample_id string, apex_time_min double, area double, area_rank int")
    got = sorted((r["reference_rt"], r["sample_rt"]) for r in A.landmarks(p, "A", 1.0).collect())
    assert got == [(1.0, 1.1), (1.2, 1.9)]


def test_robust_shift(spark):
    rows = [("B", float(x)) for x in (0.1, 0.11, 0.12, 0.13, 2.0)] + [("C", 0.5), ("C", 0.7)] + [("D", 1.0)] * 4
    got = {r["sample_id"]: r["rt_shift"] for r in A.robust_shifts(spark.createDataFrame(rows, "sample_id string, rt_shift double")).collect()}
    assert got == pytest.approx({"B": 0.115, "C": 0.6, "D": 1.0})


def sequential(points, ppm):
    out = []
    for mz, w in sorted(points):
        if out and abs(mz - out[-1][0] / out[-1][1]) <= out[-1][0] / out[-1][1] * ppm / 1e6:
            out[-1][0] += mz * w
            out[-1][1] += w
        else:
            out.append([mz * w, w])
    return [a / b for a, b in out]


def test_clusters_equal_the_sequential_fold(spark):
    rng = np.random.default_rng(4)
    pts = [(float(500 + 0.004 * x), float(w)) for x, w in zip(rng.integers(0, 400, 300), rng.integers(1, 50, 300))]
    df = spark.createDataFrame([("A", str(i), mz, w) for i, (mz, w) in enumerate(pts)], "sample_id string, scan_id string, mz double, intensity double")
    got = sorted(r["cluster_mz"] for r in M.clusters(df, ["sample_id"], 20.0).collect())
    assert got == pytest.approx(sequential(pts, 20.0))


def test_match_and_group_features(spark):
    rows = [("A", 500.0, 5.0, 100.0), ("B", 500.004, 5.05, 400.0), ("B", 500.02, 5.0, 1.0), ("A", 700.0, 8.0, 50.0)]
    f = spark.createDataFrame(rows, "sample_id string, mz double, rt double, area double")
    m = M.match_features(f)
    of = {(r["sample_id"], r["mz"]): r["feature_group_id"] for r in m.collect()}
    assert of["A", 500.0] == of["B", 500.004] and len({*of.values()}) == 3 and of["A", 700.0] == "FG0003"
    roles = spark.createDataFrame([("A", "reference"), ("B", "target")], "sample_id string, role string")
    g = {r["feature_group_id"]: r for r in M.feature_groups(m, roles).collect()}
    one = g[of["A", 500.0]]
    assert one["difference_type"] == "increased" and one["confidence_score"] == pytest.approx(0.5 + 2 / 6) and one["max_fold_change"] == 4 and one["sample_presence"] == {"A": True, "B": True}
    assert g["FG0003"]["difference_type"] == "missing_feature" and g["FG0003"]["area_by_sample"] == {"A": 50.0, "B": 0.0}
    wide = M.feature_matrix(M.feature_groups(m, roles), ["A", "B", "Z"]).where("feature_group_id = 'FG0003'").first()
    assert (wide["area_A"], wide["area_B"], wide["area_Z"]) == (50.0, 0.0, None)


def test_xic_peaks_suppress_overlap(spark):
    v = [gauss(0.02 * i, 1.0, 0.05, 9000) + gauss(0.02 * i, 2.0, 0.05, 5000) for i in range(151)]
    got = K.xic_peaks(curve(spark, v, 0.02), ["sample_id"]).orderBy("area_rank").collect()
    assert [r["rt_apex"] for r in got] == pytest.approx([1.0, 2.0]) and all(r["rt_start"] < r["rt_apex"] < r["rt_end"] for r in got)


def test_xic_features_loop(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 25):
        v = rng.integers(0, 60, n).astype(float) ** 2
        df = curve(spark, v).withColumn("observed_mz", F.lit(500.1)).withColumn("target_mz", F.lit(500.0))
        r = K.xic_features(df, ["sample_id"]).first()
        top = int(np.argmax(v))
        noise = max(float(np.median(v[v <= np.quantile(v, 0.4)])), float(np.quantile(v, 0.1)), 1e-9)
        hit = v[top] >= max(3 * noise, 0.02 * v[top])
        a = b = top
        level = max(noise, v[top] * (0.02 if hit else 0.005))
        while a > 0 and v[a] > level:
            a -= 1
        while b < n - 1 and v[b] > level:
            b += 1
        if b <= a:
            a, b = max(0, top - 1), min(n - 1, top + 1)
        assert (r["rt_start"], r["rt_apex"], r["rt_end"]) == pytest.approx((0.1 * a, 0.1 * top, 0.1 * b))
        assert r["area"] == pytest.approx(sum((v[i] + v[i - 1]) / 2 * 0.1 for i in range(a + 1, b + 1))) and r["match_status"] == ("matched" if hit else "gap_filled")


def test_band_join_equals_naive(spark):
    rng = np.random.default_rng(6)
    pts = spark.createDataFrame([("A", "s", 1.0, float(x), 1.0) for x in rng.uniform(400, 500, 400)], "sample_id string, scan_id string, rt double, mz double, intensity double")
    t = spark.createDataFrame([(float(x), 0.7) for x in rng.uniform(400, 500, 30)], "target_mz double, tolerance double")
    got = P.band_join(pts, t, 0.5).count()
    assert got == pts.crossJoin(t).where("abs(mz - target_mz) <= tolerance").count()
    assert "NestedLoop" not in P.band_join(pts, t, 0.5)._jdf.queryExecution().executedPlan().toString()


def test_nearest_bin_ties(spark):
    pts = spark.createDataFrame([(1, "A", "s", m, 1.0) for m in (10.0, 10.5, 11.0, 12.6)], "peak_id int, sample_id string, scan_id string, mz double, intensity double")
    bins = spark.createDataFrame([(1, 0, 10.25), (1, 1, 10.75)], "peak_id int, bin_index int, bin_mz double")
    got = {r["mz"]: r["bin_index"] for r in P.nearest_bin(pts, bins, 0.5, ["peak_id"], ["mz"]).collect()}
    assert got == {10.0: 0, 10.5: 1, 11.0: 1}


def test_scans_and_points_round_trip(spark):
    df = spark.createDataFrame([("A", "s1", 1.0, 5.0, 7.0), ("A", "s1", 1.0, 6.0, 7.0), ("A", "s1", 1.0, 4.0, 1.0)], "sample_id string, scan_id string, rt double, mz double, intensity double")
    s = P.to_scans(df, ["mz"])
    r = s.first()
    assert r["mz_array"] == [4.0, 5.0, 6.0] and r["base_peak_mz"] == 5.0 and r["tic"] == 15.0
    assert P.to_points(s).select("mz", "intensity").collect() == df.orderBy("mz").select("mz", "intensity").collect()


GRID = G.Grid(0.0, 4.0, 499.0, 503.0, 40, 4)


def cohort(spark, scale, center=(1.0, 1.0, 1.0), width=0.12):
    rows = [(s, f"{s}{i}", 0.1 * i, m, gauss(0.1 * i, c, width, 1000) * k) for s, k, c in zip("ABC", scale, center) for i in range(21) for m in (500.0, 500.6, 501.0)]
    return spark.createDataFrame(rows, "sample_id string, scan_id string, rt double, mz double, intensity double")


def test_cohort_scores(spark):
    pts = cohort(spark, (1, 5, 10))
    samples = pts.select("sample_id").distinct()
    c = G.cells(pts, GRID)
    by = lambda how: {(r["mz_index"], r["rt_index"]): r["score"] for r in G.cohort_scores(G.neighbourhood(c, GRID, samples, how)).collect()}
    assert by("none")[1, 10] < 0.6 and by("max")[1, 10] > 0.95 and (3, 35) not in by("max")
    drift = G.cells(cohort(spark, (1, 1, 1), (1.0, 1.08, 1.0)), GRID)
    assert {(r["mz_index"], r["rt_index"]): r["score"] for r in G.cohort_scores(G.neighbourhood(drift, GRID, samples, "max")).collect()}[2, 10] > 0.9


def test_grid_truncates_towards_zero(spark):
    pts = spark.createDataFrame([("A", "s", rt, mz, 1.0) for rt, mz in ((-0.05, 499.5), (3.99, 499.5), (4.0, 499.5), (1.0, 503.0), (1.0, 498.5), (-0.2, 500.0))], "sample_id string, scan_id string, rt double, mz double, intensity double")
    assert sorted((r["mz_index"], r["rt_index"]) for r in G.cells(pts, GRID).collect()) == [(0, 0), (0, 10), (0, 39)]


def test_distinct_regions_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), float(w), float(w), float(i)) for i, (a, b, w) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(0, 40, 80), rng.integers(0, 9, 80)))]
    df = spark.createDataFrame(rows, "mz_index int, rt_index int, weighted_difference_score double, difference_score double, max_intensity double")
    got = [(r["mz_index"], r["rt_index"]) for r in G.distinct_regions(df, GRID, 9).orderBy("region_rank").collect()]
    kept = []
    for m, t, *_ in sorted(rows, key=lambda r: (-r[2], -r[3], -r[4], r[0], r[1])):
        if not any(abs(t - b) < 2 * GRID.rt_radius + 1 and abs(m - a) < 2 * GRID.mz_radius + 1 for a, b in kept):
            kept.append((m, t))
    assert got == kept[:9]


def test_zoom_and_window(spark):
    z = G.Grid.zoom(14.0, 10.0, 600.0, 400.0)
    assert (z.rt_bins, z.mz_bins, z.rt_min, z.mz_max) == (80, 200, 10.0, 600.0)
    g = G.Grid(0, 4, 100, 104, 4, 4)
    c = spark.createDataFrame([("A", m, t, 1.0) for m in range(4) for t in range(4)], "sample_id string, mz_index int, rt_index int, raw double")
    assert sorted({(r["mz_index"], r["rt_index"]) for r in G.window(c, g, 1, 2, 101, 102).collect()}) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r["mz_index"], r["rt_index"]) for r in G.window(c, g, 9, 8, 0, 100).collect()} == {(0, 3)}


def test_abundance_ranks_first(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 10.0, 1.0), (1, 9, 0.5, 1000.0, 1.0)], "mz_index int, rt_index int, difference_score double, group_mean_intensity double, max_intensity double")
    assert G.ranked(G.abundance_weighted(df)).orderBy("region_rank").first()["group_mean_intensity"] == 1000.0


def test_changed_mz_spacing(spark):
    rows = [(1, i, mz, s) for i, (mz, s) in enumerate([(500.0, 3.0), (500.5, 9.0), (501.2, 5.0), (503.0, 1.0)])]
    df = spark.createDataFrame(rows, "peak_id int, bin_index int, bin_mz double, ranking_score double")
    assert [r["bin_mz"] for r in C.top_changes(df).orderBy("candidate_rank").collect()] == [500.5, 503.0]


def test_global_features_merge(spark):
    cols = "feature_group_id string, peak_id int, representative_mz double, representative_rt double, difference_score double, max_area double, max_fold_change double, difference_type string, sample_count int, abundance_score double"
    rows = [("a", 1, 500.0, 5.0, 0.5, 10.0, 2.0, "x", 2, 1.0), ("b", 2, 500.6, 5.5, 0.4, 90.0, 3.0, "x", 2, 1.0), ("c", 3, 502.0, 5.0, 0.3, 1.0, 1.0, "x", 2, 0.5)]
    got = C.global_features(spark.createDataFrame(rows, cols)).collect()
    assert [(r["feature_group_id"], r["merged_feature_count"], r["max_area"], r["merged_peak_ids"]) for r in got] == [("a", 2, 90.0, ["1", "2"]), ("c", 1, 1.0, ["3"])]


def test_peak_first(spark):
    rows = []
    for s, h in (("A", 1.0), ("B", 1.0), ("C", 3.0)):
        for i in range(200):
            rt = 3.5 + 0.03 * i
            for mz, at in ((548.3, 4.8), (732.4, 6.35), (914.6, 8.2)):
                rows.append((s, f"{s}{i}", rt, mz, gauss(rt, at, 0.08, 50000 * (h if mz > 900 else 1.0)) + 20 + (i * 7919 % 13)))
    out = peak_first(spark.createDataFrame(rows, "sample_id string, scan_id string, rt double, mz double, intensity double"), "A")
    peaks = out["peak_results"].orderBy("rt_apex").collect()
    assert len(peaks) >= 3 and all(0 <= r["peak_consistency_score"] <= 1.0001 for r in peaks)
    top = out["global_features"].collect()[0]
    assert top["representative_mz"] == pytest.approx(914.6, abs=0.5)
    assert out["alignment"].count() == 3 and out["features"].count() == 3 * out["feature_groups"].count()


def test_choose_reference():
    assert choose_reference(["a", "b"]) == "a" and choose_reference(["a", "b"], "b") == "b" and choose_reference(["a", "b1"], None, ("z",), "b") == "b1"
    with pytest.raises(ValueError):
        choose_reference(["a"], "z")


def test_auto_regions(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0 + 1e-12), (3, 2.0, 5.0)], "region_rank int, rt double, mz double")
    assert [(r["region_id"], r["region_rank"]) for r in matrices.auto_regions(df, "h").orderBy("source_rank").collect()] == [("AUTO_00001", 1), ("AUTO_00002", 3)]
