"""Folds in pieces and islands against one fold over everything."""

import collections
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import compare as C
from scanlake.operators import match as M
from scanlake.operators import peaks as K
from scanlake.operators.shared import islands
from scanlake.schema import PeakParams


def one_fold(rows, near):
    """Clusters of (mz, intensity, scan) in order: (centre, sum, max, scans)."""
    out = []
    for mz, w, scan in sorted(rows):
        if not out or abs(mz - out[-1][0] / out[-1][1]) > near(out[-1][0] / out[-1][1]):
            out.append([0.0, 0.0, 0.0, set()])
        c = out[-1]
        c[0], c[1], c[2] = c[0] + mz * w, c[1] + w, max(c[2], w)
        c[3].add(scan)
    return [(round(c[0] / c[1], 9), c[1], c[2], len(c[3])) for c in out]


@pytest.mark.parametrize("ppm,da", [(20.0, 0.5), (None, 0.01)])
def test_wide_islands_in_pieces(spark, ppm, da):
    """Two samples whose m/z have no gap; a third of all points at one m/z; pieces far shorter than an island."""
    rng = np.random.default_rng(5)
    near = (lambda c: max(c * ppm / 1e6, 1e-9)) if ppm else (lambda c: da)
    rows = []
    for s, n in (("a", 3000), ("b", 1500), (None, 0)):
        mz = np.round(500 + rng.random(n) * 0.3, 5)
        mz[: n // 3] = 500.12345
        rows += [(s, float(m), float(w), f"s{k}", 7) for m, w, k in zip(mz, rng.integers(0, 5, n), rng.integers(0, 40, n))]
    df = spark.createDataFrame(rows, "sample_id string, mz double, intensity double, scan_id string, _bin int")
    order = ("mz", "intensity", "scan_id")
    want = collections.Counter((s, *c) for s in ("a", "b") for c in one_fold([r[1:4] for r in rows if r[0] == s and r[2] > 0], near))
    assert len(want) > 20
    for pieces in (10**6, 700):
        got = M.clusters(df.drop("_bin"), ["sample_id"], ppm, da, order, piece_rows=pieces).collect()
        assert collections.Counter((r[0], round(r[1], 9), *r[2:]) for r in got) == want


def test_pieces_that_never_forget(spark):
    """One cluster over all pieces: the state passes through every one of them."""
    rows = [(500 + i * 1e-7, 1.0, f"s{i % 9}") for i in range(400)] + [(500.02 + i * 1e-4, 1.0, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "mz double, intensity double, scan_id string")
    got = [(round(r[0], 9), *r[1:]) for r in M.clusters(df, [], 20.0, piece_rows=150).collect()]
    assert sorted(got) == sorted(one_fold(rows, lambda c: c * 20e-6))


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0, "s")], "mz double, intensity double, scan_id string")
    assert M.clusters(df, [], 20.0).count() == 0 and M.clusters(df.limit(0), [], None).count() == 0


def quadratic_match(rows, ppm, reach):
    groups, of = [], []
    for who, mz, rt in rows:
        best, at = float("inf"), None
        for k, g in enumerate(groups):
            centre, apex = g[0] / g[2], g[1] / g[2]
            tol = abs(centre) * ppm / 1e6
            if who not in g[3] and abs(mz - centre) <= tol and abs(rt - apex) <= reach:
                far = abs(mz - centre) / max(tol, 1e-12) + abs(rt - apex) / reach
                if far < best:
                    best, at = far, k
        if at is None:
            at = len(groups)
            groups.append([0.0, 0.0, 0, set()])
        g = groups[at]
        g[0], g[1], g[2] = g[0] + mz, g[1] + rt, g[2] + 1
        g[3].add(who)
        of.append(at)
    return of


def some_features(n, seed, width):
    rng = np.random.default_rng(seed)
    return sorted({(float(np.round(500 + rng.random() * width, 4)), float(np.round(rng.random() * 8, 2)), f"s{rng.integers(5)}") for _ in range(n)})


@pytest.mark.parametrize("n,width", [(700, 0.5), (900, 40.0), (0, 1.0)])
def test_matching_in_islands_is_one_pass(spark, n, width):
    rows = some_features(n, n, width)
    want = collections.defaultdict(set)
    for (mz, rt, who), k in zip(rows, quadratic_match([(w, m, t) for m, t, w in rows], 20.0, 0.2)):
        want[k].add((who, mz, rt))
    df = spark.createDataFrame([(w, m, t, 1.0) for m, t, w in rows], "sample_id string, mz double, rt double, area double")
    got = collections.defaultdict(set)
    for r in M.match_features(df).collect():
        got[r["feature_group_id"]].add((r["sample_id"], r["mz"], r["rt"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_open_groups_are_near_linear():
    """One island of 200,000 features without a gap: a feature looks at the open groups near it alone."""
    rng = np.random.default_rng(1)
    n = 200_000
    mz, rt, who = np.sort(500 + rng.random(n) * 40), rng.random(n) * 60, rng.integers(0, 50, n)
    groups, began = M.OpenGroups(20.0, 0.2), time.time()
    of = [groups.join(a, b, c) for a, b, c in zip(who.tolist(), mz.tolist(), rt.tolist())]
    assert time.time() - began < 60
    assert of[:3000] == quadratic_match(list(zip(who[:3000].tolist(), mz[:3000].tolist(), rt[:3000].tolist())), 20.0, 0.2)


@pytest.mark.parametrize("mode", ["ppm", "da"])
def test_global_merge_in_islands(spark, mode):
    p = PeakParams(mz_tolerance_mode=mode, mz_tolerance_da=0.05)
    rng = np.random.default_rng(2)
    rows = [(f"g{i:04d}", int(rng.integers(9)), float(500 + rng.random() * (1 if i % 2 else 900)), float(rng.random() * 30), float(rng.integers(0, 4)) / 4, float(rng.random()), float(rng.integers(1, 5)), 2.0, "x", 3) for i in range(800)]
    names = ["feature_group_id", "peak_id", "representative_mz", "representative_rt", "difference_score", "abundance_score", "max_area", "max_fold_change", "difference_type", "sample_count"]
    df = spark.createDataFrame(rows, "feature_group_id string, peak_id int, representative_mz double, representative_rt double, difference_score double, abundance_score double, max_area double, max_fold_change double, difference_type string, sample_count int")
    most = max(r[5] for r in rows)
    x = [dict(zip(names, r)) | {"ranking_score": r[4] * (1 + p.feature_abundance_weight * (r[5] / most))} for r in rows]
    x.sort(key=lambda r: (-r["ranking_score"], -r["difference_score"], -r["max_area"], r["representative_rt"], r["feature_group_id"]))
    heads = []
    for r in x:
        m = r["representative_mz"]
        tol = (m * p.mz_tolerance_ppm / 1e6 if mode == "ppm" else p.mz_tolerance_da) * p.global_feature_mz_merge_tolerance_factor
        near = next((h for h in heads if abs(m - h[0]["representative_mz"]) <= tol and abs(r["representative_rt"] - h[0]["representative_rt"]) <= 0.8), None)
        if near is None:
            heads.append([r])
        else:
            near.append(r)
    assert 50 < len(heads) < 800
    want = {h[0]["feature_group_id"]: (len(h), sorted(r["feature_group_id"] for r in h), round(max(r["difference_score"] for r in h), 9), h[0]["representative_mz"]) for h in heads}
    got = {r["feature_group_id"]: (r["merged_feature_count"], r["merged_feature_group_ids"], round(r["difference_score"], 9), r["representative_mz"]) for r in C.global_features(df, p, 10_000).collect()}
    assert got == want
    best = [r["ranking_score"] for r in C.global_features(df, p, 20).collect()]
    assert best == sorted(best, reverse=True) and len(best) == 20 and math.isclose(best[0], x[0]["ranking_score"])
    assert C.global_features(df.limit(0), p).count() == 0


def test_candidate_merge_in_parts(spark):
    """Apexes in clumps: as many parts, and the same peaks as one fold."""
    p = PeakParams()
    rng = np.random.default_rng(4)
    shape = ["height", "body_height", "area", "width", "prominence", "snr", "area_ratio", "noise_level"]
    rows = []
    for i in range(300):
        apex = float(np.round(rng.integers(20) * 2 + rng.random() * 0.6, 3))
        w = float(rng.random() * 0.4 + 0.01)
        rows.append((f"s{rng.integers(4)}", apex - w / 2, apex, apex + w / 2, *map(float, rng.random(3) * 100), w, *map(float, rng.random(4))))
    schema = "sample_id string, rt_start double, rt_apex double, rt_end double, " + ", ".join(f"{c} double" for c in shape)
    samples = spark.createDataFrame(rows, schema)
    got = K.merge_candidates(samples.limit(0), samples, p)
    reps = []
    for r in sorted(rows, key=lambda r: (r[2], -r[6], r[0])):
        near = max(2 * p.min_apex_distance_min, min(p.max_local_shift_min, 0.35 * max(r[7], p.min_width)))
        rep = next((x for x in reps if abs(x["apex"] - r[2]) <= near), None)
        if rep is None:
            reps.append({"apex": r[2], "area": r[6], "who": {r[0]}})
            continue
        if r[6] > rep["area"]:
            rep["apex"], rep["area"] = r[2], r[6]
        rep["who"].add(r[0])
    assert sorted((r["rt_apex"], r["area"], tuple(r["supporting_samples"])) for r in got.collect()) == sorted((x["apex"], x["area"], tuple(sorted(x["who"]))) for x in reps)
    cuts = islands(samples, [], "rt_apex", F.floor(F.col("rt_apex") / 0.05).cast("long"), F.lit(0.1))
    assert cuts.agg(F.max("island")).first()[0] >= 20


def test_sparse_neighbourhoods(spark):
    """A huge grid with few occupied cells, at its corners too, against a look at every neighbour."""
    from scanlake.operators import grid as G

    g = G.Grid(0, 5000, 0, 90_000, 100_000, 90_000)
    rng = np.random.default_rng(8)
    cells = {(s, int(m), int(t)): float(rng.integers(0, 9)) for s in "ab" for m, t in [*rng.integers(100, 130, (60, 2)), (0, 0), (89_999, 99_999)]}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "sample_id string, mz_index int, rt_index int, raw double")
    want = collections.defaultdict(float)
    for (s, m, t), v in cells.items():
        for a in range(max(0, m - g.mz_radius), min(g.mz_bins, m + g.mz_radius + 1)):
            for b in range(max(0, t - g.rt_radius), min(g.rt_bins, t + g.rt_radius + 1)):
                want[s, a, b] = max(want[s, a, b], v)
    got = {tuple(r[:3]): r[3] for r in G.local_max(df, g).collect()}
    assert got == {k: v for k, v in want.items() if v > 0}
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    near = G.neighbourhood(df, g, samples, "none").collect()
    places = {k[1:] for k in got}
    assert {(r["sample_id"], r["mz_index"], r["rt_index"]) for r in near} == {(s, *p) for s in "abc" for p in places} and len(near) == 3 * len(places)
    assert all(r["raw"] == 0 for r in near if r["sample_id"] == "c")
