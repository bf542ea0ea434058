"""SQL counterparts of the greedy steps: recursive common tables that take one ranked row at a time.

They state the steps once more, over lists, so that they share nothing with the operators but the rules.
"""

from __future__ import annotations

from scanlake.plans.catalogue import CHROM_SQL, CROWDED, CURVE, DUCK_POINTS, GRID, MATRIX_SQL, ORACLE, PEAKS_SQL, RESAMPLED_SQL, SPECTRUM_SQL, XIC_SQL, scores_sql


def register(name: str, sql: str) -> None:
    ORACLE[name] = f"WITH RECURSIVE p AS ({DUCK_POINTS}), {sql}"


def tic_sql(src: str, z: str) -> str:
    """Common tables up to {z}pk, the TIC peaks of src (g, rt, v) by group g."""
    return f"""
 {z}m AS (SELECT g, rt, v, avg(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM {src} WINDOW w AS (PARTITION BY g ORDER BY rt)),
 {z}k AS (SELECT *, greatest(sm - min(sm) OVER (PARTITION BY g ORDER BY rt ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 0) AS cor FROM {z}m),
 {z}q AS (SELECT g, quantile_cont(cor, 0.4) AS q4, quantile_cont(cor, 0.1) AS q1 FROM {z}k GROUP BY g),
 {z}lo AS (SELECT g, cor, q1, median(cor) OVER (PARTITION BY g) AS md FROM {z}k JOIN {z}q USING (g) WHERE cor <= q4 + 1e-9),
 {z}nl AS (SELECT g, greatest(any_value(md) + 1.4826 * median(abs(cor - md)), any_value(q1), 1e-9) AS noise FROM {z}lo GROUP BY g),
 {z}b AS (SELECT g, rt, cor, noise, avg(cor) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS body, row_number() OVER w AS i, (cor + lag(cor) OVER w) / 2 * (rt - lag(rt) OVER w) AS step
          FROM {z}k JOIN {z}nl USING (g) WINDOW w AS (PARTITION BY g ORDER BY rt)),
 {z}c AS (SELECT *, lag(body) OVER w AS bl, lead(body) OVER w AS br, rt - lag(rt) OVER w AS dt, sum(coalesce(step, 0)) OVER w AS cum FROM {z}b WINDOW w AS (PARTITION BY g ORDER BY i)),
 {z}ls AS (SELECT g, any_value(noise) AS noise, list(rt ORDER BY i) AS r, list(body ORDER BY i) AS b, list(cor ORDER BY i) AS y, list(cum ORDER BY i) AS t, count(*) AS n,
           greatest(1, CAST(trunc(0.02 / greatest(coalesce(median(dt) FILTER (dt > 0), 0.01), 1e-9)) AS BIGINT)) AS gap FROM {z}c GROUP BY g),
 {z}tp AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY body DESC, i) AS k FROM {z}c WHERE body >= greatest(noise * 5, 1e-9) AND body >= bl AND body >= br),
 {z}ap AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM {z}ls UNION ALL
           SELECT a.g, t.k, CASE WHEN len(list_filter(a.kept, lambda x: abs(x - t.i) <= l.gap)) = 0 THEN list_append(a.kept, t.i) ELSE a.kept END
           FROM {z}ap a JOIN {z}tp t ON t.g = a.g AND t.k = a.k + 1 JOIN {z}ls l ON l.g = a.g),
 {z}so AS (SELECT g, list_sort(arg_max(kept, k)) AS a FROM {z}ap GROUP BY g),
 {z}fo AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS x FROM {z}so UNION ALL
           SELECT g, k + 1, CASE WHEN j IS NULL THEN [i] WHEN depth < 0.05 OR (r[i] - r[j] <= 0.3 AND depth < 0.35) THEN CASE WHEN b[i] > b[j] THEN list_append(x[1:len(x) - 1], i) ELSE x END ELSE list_append(x, i) END
           FROM (SELECT *, CASE WHEN least(b[i], b[j]) > 0 THEN (least(b[i], b[j]) - list_min(b[j:i])) / least(b[i], b[j]) ELSE 0 END AS depth
                 FROM (SELECT f.g, f.k, f.x, s.a[f.k + 1] AS i, f.x[len(f.x)] AS j, l.r, l.b FROM {z}fo f JOIN {z}so s ON s.g = f.g JOIN {z}ls l ON l.g = f.g WHERE f.k < len(s.a)))),
 {z}fx AS (SELECT g, arg_max(x, k) AS x FROM {z}fo GROUP BY g),
 {z}e1 AS (SELECT x.g, k, x.x[k] AS i, x.x[k - 1] AS pi, x.x[k + 1] AS ni, l.* EXCLUDE (g) FROM {z}fx x JOIN {z}ls l ON l.g = x.g, range(1, len(x.x) + 1) u(k)),
 {z}e2 AS (SELECT *, greatest(noise, b[i] * 0.08) AS level, CASE WHEN k > 1 THEN pi + list_position(b[pi:i], list_min(b[pi:i])) - 1 END AS vl, i + list_position(b[i:ni], list_min(b[i:ni])) - 1 AS vr FROM {z}e1),
 {z}e3 AS (SELECT *, greatest(coalesce(list_max(list_filter(range(1, i + 1), lambda j: b[j] <= level)), 1), coalesce(vl, 1)) AS lf,
           least(coalesce(list_min(list_filter(range(i, n + 1), lambda j: b[j] <= level)), n), CASE WHEN ni IS NULL THEN n ELSE vr END) AS rg FROM {z}e2),
 {z}e4 AS (SELECT *, lf + list_position(b[lf:rg], list_max(b[lf:rg])) - 1 AS top FROM {z}e3 WHERE rg > lf),
 {z}e5 AS (SELECT g, k, r[lf] AS rt_start, r[top] AS rt_apex, r[rg] AS rt_end, y[top] AS height, b[top] AS body_height, t[rg] - t[lf] AS area, r[rg] - r[lf] AS width,
           greatest(b[top] - greatest(b[lf], b[rg]), 0) AS prominence, b[top] / noise AS snr, CASE WHEN t[n] > 0 THEN (t[rg] - t[lf]) / t[n] ELSE 0 END AS area_ratio, noise AS noise_level FROM {z}e4),
 {z}e6 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY area DESC, k) AS area_rank FROM {z}e5),
 {z}pk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rt_apex, area_rank) AS rt_rank FROM {z}e6)"""


def refine_sql(src: str, z: str) -> str:
    """Common tables up to {z}rf: src with bounds shared or reaching out."""
    shared = lambda end, start, a, b: f"CASE WHEN {start} - {end} < 0 THEN ({a} + {b}) / 2 ELSE ({end} + {start}) / 2 END"
    return f"""
 {z}r1 AS (SELECT *, lead(rt_start) OVER w AS ns, lead(rt_apex) OVER w AS na, lag(rt_end) OVER w AS pe, lag(rt_apex) OVER w AS pa FROM {src} WINDOW w AS (PARTITION BY g ORDER BY rt_apex)),
 {z}r2 AS (SELECT *, CASE WHEN ns - rt_end <= 0.08 THEN least({shared('rt_end', 'ns', 'rt_apex', 'na')}, na) ELSE rt_end END AS e1,
           CASE WHEN rt_start - pe <= 0.08 THEN greatest({shared('pe', 'rt_start', 'pa', 'rt_apex')}, pa) ELSE rt_start END AS s1 FROM {z}r1),
 {z}r3 AS (SELECT *, lead(s1) OVER (PARTITION BY g ORDER BY rt_apex) AS n1 FROM {z}r2),
 {z}r4 AS (SELECT *, CASE WHEN n1 IS NULL THEN e1 + 0.03 WHEN n1 - e1 > 0.08 THEN e1 + least(0.03, (n1 - e1) * 0.4) ELSE e1 END AS o1 FROM {z}r3),
 {z}r5 AS (SELECT *, lag(o1) OVER (PARTITION BY g ORDER BY rt_apex) AS p1 FROM {z}r4),
 {z}r6 AS (SELECT *, CASE WHEN p1 IS NULL THEN greatest(0, s1 - 0.03) WHEN s1 - p1 > 0.08 THEN s1 - least(0.03, (s1 - p1) * 0.4) ELSE s1 END AS i1 FROM {z}r5),
 {z}rf AS (SELECT * EXCLUDE (rt_start, rt_end, width, ns, na, pe, pa, e1, s1, n1, o1, p1, i1), i1 AS rt_start, o1 AS rt_end, greatest(o1 - i1, 0) AS width FROM {z}r6)"""


STATUS = """CASE WHEN snr < 3.0 OR width < 0.015 THEN 'noise_peak' WHEN snr < 5 OR prominence < noise_level * 3 OR area < 0 OR area_ratio < 0.00001 OR NOT width BETWEEN 0.03 AND 3 THEN 'weak_peak' ELSE 'confirmed_peak' END"""
SHAPE = {"rt_start": 6, "rt_apex": 6, "rt_end": 6, "height": 4, "body_height": 4, "area": 3, "width": 6, "prominence": 4, "snr": 5, "area_ratio": 8, "noise_level": 4}
PEAK = ", ".join(f"round({c}, {d}) AS {c}" for c, d in SHAPE.items())
RANKS = "CAST(rt_rank AS INT) AS rt_rank, CAST(area_rank AS INT) AS area_rank"
SAMPLES_SQL = f"{CURVE}, cv AS (SELECT sample_id AS g, rt, tic AS v FROM c), {tic_sql('cv', 's')}"

register("tic_peaks", f"{SAMPLES_SQL} SELECT g AS sample_id, {RANKS}, {PEAK} FROM spk")
register("refine_boundaries", f"{SAMPLES_SQL}, {refine_sql('spk', 's')} SELECT g AS sample_id, {RANKS}, {PEAK} FROM srf")
register("peak_status", f"{SAMPLES_SQL}, {refine_sql('spk', 's')} SELECT g AS sample_id, {STATUS} AS status, count(*) AS count FROM srf GROUP BY ALL")


def merged_sql(curves: str) -> str:
    """Common tables up to cand: the merged candidates of curves (g, rt, v), with peak_id in RT order."""
    cols = list(SHAPE)
    pack = "struct_pack(" + ", ".join(f"{c} := {{0}}.{c}" for c in cols) + ", source := {1}, who := {2})"
    larger = "struct_pack(" + ", ".join(f"{c} := q.{c}" if c == "noise_level" else f"{c} := x.{c}" for c in cols) + ", source := so, who := wh)"
    other = "struct_pack(" + ", ".join({"rt_start": "rt_start := least(q.rt_start, x.rt_start)", "rt_end": "rt_end := greatest(q.rt_end, x.rt_end)"}.get(c, f"{c} := q.{c}") for c in cols) + ", source := so, who := wh)"
    return f"""
 ce AS (SELECT min(rt) AS lo, max(rt) AS hi, least(8000, greatest(100, ceil((max(rt) - min(rt)) / 0.01))) AS n FROM {curves}),
 cb AS (SELECT least(n - 1, greatest(0, trunc((rt - lo) / ((hi - lo) / n)))) AS k, lo, (hi - lo) / n AS st, v FROM {curves}, ce),
 cs AS (SELECT 0 AS g, lo + (k + 0.5) * st AS rt, avg(v) AS v FROM cb GROUP BY k, lo, st), {tic_sql('cs', 'n')}, {refine_sql('npk', 'n')}, {tic_sql(curves, 's')}, {refine_sql('spk', 's')},
 mi AS (SELECT *, row_number() OVER (ORDER BY rt_apex, area DESC, o, sample_id NULLS FIRST) AS r FROM (
        SELECT {', '.join(cols)}, 'consensus_tic' AS source, NULL::VARCHAR AS sample_id, 0 AS o FROM nrf UNION ALL
        SELECT {', '.join(cols)}, 'sample_tic', g, 1 FROM srf WHERE {STATUS} <> 'noise_peak')),
 mr AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT({', '.join(c + ' DOUBLE' for c in cols)}, source VARCHAR, who VARCHAR[])[]) AS reps UNION ALL
        SELECT r + 1, CASE WHEN k IS NULL OR k = 0 THEN list_append(reps, {pack.format('x', 'x.source', "CASE WHEN x.sample_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [x.sample_id] END")})
          ELSE list_concat(list_append(reps[1:k - 1], CASE WHEN x.area > q.area THEN {larger} ELSE {other} END), reps[k + 1:]) END
        FROM (SELECT *, reps[k] AS q, CASE WHEN x.source = 'consensus_tic' THEN x.source ELSE reps[k].source END AS so, CASE WHEN x.sample_id IS NULL THEN reps[k].who ELSE list_distinct(list_append(reps[k].who, x.sample_id)) END AS wh
              FROM (SELECT mr.r, reps, x, list_position(list_transform(reps, lambda q: abs(q.rt_apex - x.rt_apex) <= greatest(0.04, least(0.1, 0.35 * greatest(x.width, 0.03)))), true) AS k FROM mr JOIN mi x ON x.r = mr.r + 1))),
 ml AS (SELECT 0 AS g, unnest(reps, max_depth := 2) FROM (SELECT arg_max(reps, r) AS reps FROM mr)), {refine_sql('ml', 'm')},
 cand AS (SELECT *, {STATUS} AS status, CAST(row_number() OVER (ORDER BY rt_apex) AS INT) AS peak_id FROM mrf)"""


register("merge_peak_candidates", f"{CURVE}, cv AS (SELECT sample_id AS g, rt, tic AS v FROM c), {merged_sql('cv')} SELECT peak_id, {PEAK}, source, array_to_string(list_sort(who), '|') AS supporting_samples, status FROM cand")

# --- alignment -------------------------------------------------------------------------------------------------------
MARKS_SQL = f"""{CHROM_SQL},
 lr AS (SELECT apex_time_min AS rt, area, row_number() OVER (ORDER BY apex_time_min, area_rank) AS k FROM peaks WHERE sample_id = 'A' AND area_rank <= 40),
 lc AS (SELECT sample_id, list(struct_pack(rk := area_rank, rt := apex_time_min, area := area) ORDER BY area_rank) AS c FROM peaks WHERE sample_id <> 'A' AND area_rank <= 80 GROUP BY sample_id),
 lm AS (SELECT sample_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST(NULL AS STRUCT(d DOUBLE, rk INT, rt DOUBLE, area DOUBLE)) AS hit FROM lc UNION ALL
        SELECT sample_id, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.rk) END, hit FROM (
          SELECT m.sample_id, r.k, m.used, list_sort(list_transform(list_filter(l.c, lambda q: NOT list_contains(m.used, q.rk) AND abs(q.rt - r.rt) <= 3), lambda q: struct_pack(d := abs(q.rt - r.rt), rk := q.rk, rt := q.rt, area := q.area)))[1] AS hit
          FROM lm m JOIN lr r ON r.k = m.k + 1 JOIN lc l ON l.sample_id = m.sample_id)),
 marks AS (SELECT sample_id, r.rt AS reference_rt, hit.rt AS sample_rt, r.rt - hit.rt AS rt_shift, r.area AS reference_area, hit.area AS sample_area FROM lm JOIN lr r USING (k) WHERE hit IS NOT NULL)"""
ROBUST_SQL = f"""{MARKS_SQL},
 h1 AS (SELECT sample_id, rt_shift, count(*) OVER (PARTITION BY sample_id) AS n, median(rt_shift) OVER (PARTITION BY sample_id) AS md FROM marks),
 h2 AS (SELECT *, median(abs(rt_shift - md)) OVER (PARTITION BY sample_id) AS mad FROM h1),
 rob AS (SELECT sample_id, CASE WHEN max(n) < 4 OR max(mad) <= 1e-9 THEN max(md) ELSE median(rt_shift) FILTER (abs(rt_shift - md) <= greatest(0.05, 3.5 * mad)) END AS rt_shift, count(*) AS landmark_count FROM h2 GROUP BY sample_id)"""
ALIGN_SQL = f"""{ROBUST_SQL},
 mp AS (SELECT sample_id, apex_time_min AS apex FROM peaks WHERE area_rank = 1), ra AS (SELECT apex AS ref FROM mp WHERE sample_id = 'A'),
 nr AS (SELECT sample_id, apex_time_min AS near FROM (SELECT *, area / max(area) OVER (PARTITION BY sample_id) * 0.55 + height / max(height) OVER (PARTITION BY sample_id) * 0.25 + (1 - abs(apex_time_min - ref) / 3) * 0.2 AS ms FROM peaks, ra WHERE abs(apex_time_min - ref) <= 3)
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ms DESC, area_rank) = 1),
 alg AS (SELECT s.sample_id, CASE WHEN s.sample_id = 'A' THEN 0 WHEN coalesce(landmark_count, 0) >= 2 THEN rt_shift ELSE ref - coalesce(near, apex, 0) END AS rt_shift,
           CASE WHEN s.sample_id = 'A' THEN coalesce(apex, 0) ELSE coalesce(near, apex, 0) END AS apex_rt, coalesce(landmark_count, 0) AS landmark_count,
           CASE WHEN s.sample_id = 'A' THEN 'largest_area' WHEN coalesce(landmark_count, 0) >= 2 THEN 'multi_peak_landmark_median' WHEN near IS NOT NULL THEN 'reference_window' WHEN apex IS NOT NULL THEN 'fallback_largest_area' END AS match_method
         FROM (SELECT DISTINCT sample_id FROM c) s LEFT JOIN mp USING (sample_id) LEFT JOIN nr USING (sample_id) LEFT JOIN rob USING (sample_id), ra)"""

register("landmarks", f"{MARKS_SQL} SELECT sample_id, reference_rt, sample_rt, rt_shift, round(reference_area, 3) AS reference_area, round(sample_area, 3) AS sample_area FROM marks")
register("robust_shift", f"{ROBUST_SQL} SELECT sample_id, round(rt_shift, 6) AS rt_shift, landmark_count FROM rob")
register("rt_alignment", f"{ALIGN_SQL} SELECT sample_id, round(rt_shift, 6) AS rt_shift, apex_rt, landmark_count, match_method FROM alg")

# --- features of m/z targets -----------------------------------------------------------------------------------------
XPEAK_SQL = f"""{XIC_SQL},
 x1 AS (SELECT sample_id, target_mz, rt, s AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY sample_id, target_mz) AS n, first_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
          last_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e, sum(s) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM x WINDOW w AS (PARTITION BY sample_id, target_mz ORDER BY rt)),
 x2 AS (SELECT *, CASE WHEN n < 3 THEN v ELSE (sm + greatest(3 - i, 0) * f + greatest(2 - (n - i), 0) * e) / 5 END AS y FROM x1),
 x3 AS (SELECT sample_id, target_mz, y, row_number() OVER (PARTITION BY sample_id, target_mz ORDER BY y) AS pos, n FROM x2),
 x4 AS (SELECT sample_id, target_mz, greatest(CASE WHEN count(*) >= 2 THEN stddev_pop(y) ELSE max(y) END, median(y) * 0.1, 1) AS noise FROM x3 WHERE pos <= greatest(3, n // 5) GROUP BY ALL),
 x5 AS (SELECT sample_id, target_mz, any_value(noise) AS noise, any_value(n) AS n, list(rt ORDER BY i) AS r, list(v ORDER BY i) AS v, list(y ORDER BY i) AS y FROM x2 JOIN x4 USING (sample_id, target_mz) GROUP BY ALL),
 x6 AS (SELECT x5.*, k AS i, greatest(2 * noise, y[k] * 0.05) AS level FROM x5, range(2, n) u(k) WHERE y[k] >= y[k - 1] AND y[k] > y[k + 1] AND y[k] >= 100 AND y[k] / noise >= 3),
 x7 AS (SELECT *, coalesce(list_max(list_filter(range(1, i + 1), lambda j: y[j] <= level)), 1) AS lf, coalesce(list_min(list_filter(range(i, n + 1), lambda j: y[j] <= level)), n) AS rg FROM x6),
 x8 AS (SELECT *, list_transform(v[lf:rg], lambda q: greatest(q - least(v[lf], v[rg]), 0)) AS part, r[lf:rg] AS pr FROM x7 WHERE r[rg] - r[lf] BETWEEN 0.03 AND 10),
 x9 AS (SELECT *, coalesce(list_sum(list_transform(range(2, len(part) + 1), lambda j: (part[j] + part[j - 1]) / 2 * (pr[j] - pr[j - 1]))), 0) AS area FROM x8),
 xa AS (SELECT *, row_number() OVER (PARTITION BY sample_id, target_mz ORDER BY y[i] DESC, i) AS k FROM x9 WHERE area >= 100),
 xk AS (SELECT DISTINCT sample_id, target_mz, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(l BIGINT, r BIGINT)[]) AS held, false AS ok FROM xa UNION ALL
        SELECT sample_id, target_mz, k, CASE WHEN ok THEN list_append(held, struct_pack(l := lf, r := rg)) ELSE held END, ok FROM (
          SELECT a.sample_id, a.target_mz, a.k, held, a.lf, a.rg, len(list_filter(held, lambda q: NOT (a.rg < q.l OR a.lf > q.r))) = 0 AS ok FROM xk JOIN xa a ON a.sample_id = xk.sample_id AND a.target_mz = xk.target_mz AND a.k = xk.k + 1)),
 xf AS (SELECT a.sample_id, a.target_mz, r[lf] AS rt_start, r[i] AS rt_apex, r[rg] AS rt_end, area, list_max(part) AS height, list_max(part) / noise AS signal_to_noise,
          CAST(row_number() OVER (PARTITION BY a.sample_id, a.target_mz ORDER BY area DESC, a.k) AS INT) AS area_rank FROM xa a JOIN xk ON ok AND a.sample_id = xk.sample_id AND a.target_mz = xk.target_mz AND a.k = xk.k)"""
register("xic_peaks", f"{XPEAK_SQL} SELECT sample_id, target_mz, rt_start, rt_apex, rt_end, round(area, 3) AS area, height, round(signal_to_noise, 5) AS signal_to_noise, area_rank FROM xf")


def match_sql(features: str) -> str:
    """Common tables up to fm: features (sample_id, mz, rt, area, height) in their groups; islands of m/z are folded side by side."""
    return f"""
 f1 AS (SELECT *, CASE WHEN mz - lag(mz) OVER w > abs(lag(mz) OVER w) * 20 / 1e6 THEN 1 ELSE 0 END AS fresh FROM {features} WINDOW w AS (ORDER BY mz, rt, sample_id)),
 f2 AS (SELECT *, sum(fresh) OVER (ORDER BY mz, rt, sample_id) AS isl FROM f1),
 f3 AS (SELECT *, row_number() OVER (PARTITION BY isl ORDER BY mz, rt, sample_id) AS k FROM f2),
 fg AS (SELECT DISTINCT isl, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(m DOUBLE, t DOUBLE, n BIGINT, who VARCHAR[])[]) AS gs, CAST(NULL AS BIGINT) AS pos FROM f3 UNION ALL
        SELECT isl, k, CASE WHEN pos > len(gs) THEN list_append(gs, struct_pack(m := mz, t := rt, n := CAST(1 AS BIGINT), who := [sample_id]))
          ELSE list_concat(list_append(gs[1:pos - 1], struct_pack(m := gs[pos].m + mz, t := gs[pos].t + rt, n := gs[pos].n + 1, who := list_append(gs[pos].who, sample_id))), gs[pos + 1:]) END, pos FROM (
          SELECT *, coalesce(list_sort(list_filter(list_transform(range(1, len(gs) + 1), lambda q: CASE WHEN NOT list_contains(gs[q].who, sample_id) AND abs(mz - gs[q].m / gs[q].n) <= abs(gs[q].m / gs[q].n) * 20 / 1e6 AND abs(rt - gs[q].t / gs[q].n) <= 0.75
              THEN struct_pack(d := abs(mz - gs[q].m / gs[q].n) / greatest(abs(gs[q].m / gs[q].n) * 20 / 1e6, 1e-12) + abs(rt - gs[q].t / gs[q].n) / 0.75, q := q) END), lambda z: z IS NOT NULL))[1].q, len(gs) + 1) AS pos
          FROM (SELECT f.isl, f.k, gs, f.sample_id, f.mz, f.rt FROM fg JOIN f3 f ON f.isl = fg.isl AND f.k = fg.k + 1))),
 f4 AS (SELECT f3.*, pos FROM f3 JOIN fg ON fg.isl = f3.isl AND fg.k = f3.k),
 f5 AS (SELECT isl, pos, row_number() OVER (ORDER BY avg(rt), avg(mz), isl, pos) AS num FROM f4 GROUP BY isl, pos),
 fm AS (SELECT sample_id, mz, rt, area, height, format('FG{{:04d}}', num) AS feature_group_id FROM f4 JOIN f5 USING (isl, pos))"""


BEST_SQL = f"{XPEAK_SQL}, bf AS (SELECT sample_id, target_mz AS mz, rt_apex AS rt, area, height FROM xf WHERE area_rank = 1), {match_sql('bf')}"
register("match_features", f"{BEST_SQL} SELECT sample_id, mz, rt, round(area, 3) AS area, height, feature_group_id FROM fm")

#: Common tables up to fgr: a row per feature group over the samples A (reference), N and R.
GROUPS_SQL = """
 gr AS (SELECT * FROM (VALUES ('A', 'reference'), ('N', 'target'), ('R', 'target')) v(sample_id, role)),
 gp AS (SELECT feature_group_id, sample_id, max(area) AS area FROM fm GROUP BY ALL),
 gf AS (SELECT feature_group_id, sample_id, role, gp.area IS NOT NULL AS present, greatest(coalesce(gp.area, 0), 0) AS area FROM (SELECT DISTINCT feature_group_id FROM fm) CROSS JOIN gr LEFT JOIN gp USING (feature_group_id, sample_id)),
 ga AS (SELECT feature_group_id, CAST(count(*) FILTER (present) AS INT) AS sample_count, CAST(count(*) FILTER (NOT present) AS INT) AS missing_sample_count,
          CASE WHEN count(*) FILTER (area > 0) >= 2 THEN stddev_pop(area) FILTER (area > 0) / avg(area) FILTER (area > 0) END AS cv, max(area) AS mx, min(area) FILTER (area > 0) AS mn,
          coalesce(avg(area) FILTER (role = 'reference'), 0) AS ref, coalesce(avg(area) FILTER (role = 'target'), 0) AS tar, coalesce(bool_or(area > 1) FILTER (role = 'reference'), false) AS rp, coalesce(bool_or(area > 1) FILTER (role = 'target'), false) AS tp,
          max(area) FILTER (sample_id = 'A') AS area_A, max(area) FILTER (sample_id = 'N') AS area_N, max(area) FILTER (sample_id = 'R') AS area_R FROM gf GROUP BY ALL),
 gm AS (SELECT feature_group_id, avg(mz) AS representative_mz, avg(rt) AS representative_rt, abs(avg(rt) FILTER (role = 'target') - avg(rt) FILTER (role = 'reference')) AS away FROM fm JOIN gr USING (sample_id) GROUP BY ALL),
 gc AS (SELECT *, CASE WHEN tar <= 0 AND ref <= 0 THEN NULL ELSE greatest(tar, 1) / greatest(ref, 1) END AS fc, coalesce(away > 0.2, false) AS moved FROM ga JOIN gm USING (feature_group_id)),
 fgr AS (SELECT feature_group_id, representative_mz, representative_rt, sample_count, missing_sample_count, cv, coalesce(mx / greatest(mn, 1), fc) AS max_fold_change,
   CASE WHEN moved AND rp AND tp THEN 'rt_shift' WHEN tp AND NOT rp THEN 'new_feature' WHEN rp AND NOT tp THEN 'missing_feature' WHEN fc >= 2 THEN 'increased' WHEN fc <= 0.5 THEN 'decreased' WHEN rp AND tp THEN 'common_feature' ELSE 'uncertain' END AS difference_type,
   CASE WHEN moved AND rp AND tp THEN 0.75 WHEN tp <> rp THEN 0.9 WHEN fc >= 2 OR fc <= 0.5 THEN least(0.95, 0.5 + abs(log2(fc)) / 6) WHEN rp AND tp THEN 0.7 ELSE 0.3 END AS confidence_score, area_A, area_N, area_R FROM gc)"""
GROUP = "feature_group_id, round(representative_mz, 6) AS representative_mz, round(representative_rt, 6) AS representative_rt, sample_count, missing_sample_count, round(cv, 6) AS cv, round(max_fold_change, 5) AS max_fold_change, difference_type, round(confidence_score, 6) AS confidence_score"
AREAS = ", ".join(f"round(area_{x}, 3) AS area_{x}" for x in "ANR")
register("feature_groups", f"{BEST_SQL}, {GROUPS_SQL} SELECT {GROUP} FROM fgr")
register("feature_matrix_pivot", f"{BEST_SQL}, {GROUPS_SQL} SELECT {GROUP}, {AREAS} FROM fgr")

#: The adapter's clusters are its nominal m/z: their weighted means are each sample's candidates.
PIPELINE_SQL = XPEAK_SQL.replace(XIC_SQL, f"""{CURVE}, t AS (SELECT sample_id AS g, sum(mz * intensity) / sum(intensity) AS target_mz FROM p WHERE rt BETWEEN 5 AND 50 AND mz BETWEEN 200 AND 2000 AND intensity >= 100
   GROUP BY sample_id, CAST(round(mz / 10) AS INT) HAVING count(DISTINCT scan_id) >= 3 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sum(intensity) DESC, target_mz) <= 200),
 h AS (SELECT scan_id, target_mz, sum(intensity) AS s FROM p JOIN t ON g = sample_id AND abs(mz - target_mz) <= target_mz * 20 / 1e6 GROUP BY ALL),
 x AS (SELECT sample_id, c.scan_id, rt, t.target_mz, coalesce(s, 0) AS s FROM c JOIN t ON g = sample_id LEFT JOIN h ON h.scan_id = c.scan_id AND h.target_mz = t.target_mz)""")
register("feature_pipeline", f"{PIPELINE_SQL}, bf AS (SELECT sample_id, target_mz AS mz, rt_apex AS rt, area, height FROM xf WHERE area_rank = 1), {match_sql('bf')}, {GROUPS_SQL} SELECT {GROUP}, {AREAS} FROM fgr")

#: A cluster at a time: points of one m/z are one (a point at the m/z of its cluster's last is always within reach), sums up to each come
#: from running totals, and the next cluster begins at the first m/z out of reach of the mean of all since this one's beginning.
register(
    "crowded_clusters",
    f"""q AS (SELECT sample_id, {CROWDED} AS mz, sum(intensity) AS w, max(intensity) AS m, list(DISTINCT scan_id) AS s FROM p WHERE intensity > 0 GROUP BY ALL),
 ls AS (SELECT sample_id, list(mz ORDER BY mz) AS z, list(hs ORDER BY mz) AS h, list(ws ORDER BY mz) AS w FROM (SELECT sample_id, mz, sum(mz * w) OVER k AS hs, sum(w) OVER k AS ws FROM q WINDOW k AS (PARTITION BY sample_id ORDER BY mz)) GROUP BY ALL),
 cl(sample_id, a, b) AS (SELECT sample_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM ls UNION ALL
   SELECT cl.sample_id, cl.b, coalesce(list_filter(range(cl.b + 1, len(z) + 1), lambda j: abs(z[j] - (h[j - 1] - coalesce(h[cl.b - 1], 0)) / (w[j - 1] - coalesce(w[cl.b - 1], 0))) > (h[j - 1] - coalesce(h[cl.b - 1], 0)) / (w[j - 1] - coalesce(w[cl.b - 1], 0)) * 20 / 1e6)[1], len(z) + 1)
   FROM cl JOIN ls USING (sample_id) WHERE cl.b <= len(z)),
 n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY mz) AS i FROM q)
 SELECT sample_id, round(sum(mz * w) / sum(w), 6) AS cluster_mz, sum(w) AS total_intensity, max(m) AS max_intensity, CAST(len(list_distinct(flatten(list(s)))) AS BIGINT) AS scan_count
 FROM n JOIN cl USING (sample_id) WHERE cl.a > 0 AND i >= cl.a AND i < cl.b GROUP BY sample_id, cl.a""",
)

# --- scores, changes and features of peaks ---------------------------------------------------------------------------
CHROMSIM_SQL = f"""{RESAMPLED_SQL},
 z1 AS (SELECT pk.peak_id, s.sample_id, k.point, coalesce(rs.v, 0) AS v FROM pk CROSS JOIN (SELECT DISTINCT sample_id FROM c) s CROSS JOIN range(0, 100) k(point) LEFT JOIN rs ON rs.peak_id = pk.peak_id AND rs.sample_id = s.sample_id AND rs.point = k.point),
 z2 AS (SELECT *, v / CASE WHEN sum(v) OVER w = 0 THEN 1 ELSE sum(v) OVER w END AS u FROM z1 WINDOW w AS (PARTITION BY peak_id, sample_id)),
 z3 AS (SELECT *, median(u) OVER (PARTITION BY peak_id, point) AS m FROM z2),
 z4 AS (SELECT peak_id, sample_id, sqrt(sum(u * u)) * sqrt(sum(m * m)) AS nm, sum(u * m) AS um FROM z3 GROUP BY ALL),
 z5 AS (SELECT peak_id, avg(CASE WHEN nm > 0 THEN greatest(0, least(1, um / nm)) ELSE 0 END) AS shape_score FROM z4 GROUP BY ALL),
 a1 AS (SELECT *, lag(rt) OVER w AS r0, lag(v) OVER w AS v0 FROM wc WINDOW w AS (PARTITION BY peak_id, sample_id ORDER BY rt)),
 a2 AS (SELECT peak_id, sample_id, coalesce(sum((v0 + v) / 2 * (rt - r0)), 0) AS area FROM a1 GROUP BY ALL),
 a3 AS (SELECT peak_id, count(*) FILTER (area > 0) AS n, stddev_pop(area) FILTER (area > 0) / avg(area) FILTER (area > 0) AS cv FROM a2 GROUP BY ALL),
 a4 AS (SELECT peak_id, max(abs(local_shift)) AS s, max(max_shift) AS m, bool_or(capped) AS capped FROM la GROUP BY ALL),
 sim AS (SELECT peak_id, capped, shape_score, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n < 2 THEN 1 ELSE 1 / (1 + cv) END AS area_score, greatest(0, 1 - s / greatest(m, 1e-9)) * CASE WHEN capped THEN 0.5 ELSE 1 END AS apex_score, CAST(1 AS DOUBLE) AS width_score
         FROM z5 JOIN a4 USING (peak_id) LEFT JOIN a3 USING (peak_id))"""
SCORES = "round(shape_score, 6) AS shape_score, round(area_score, 6) AS area_score, round(apex_score, 6) AS apex_score, round(width_score, 6) AS width_score"
register("chrom_similarity", f"{CHROMSIM_SQL} SELECT peak_id, {SCORES}, round(0.55 * shape_score + 0.25 * area_score + 0.1 * apex_score + 0.1 * width_score, 6) AS chromatogram_score FROM sim")

CHANGED_SQL = f"""{MATRIX_SQL}, g1 AS (SELECT peak_id, bin_index, bin_mz, avg(nv) AS mean_intensity, coalesce(stddev_pop(nv) / avg(nv), 0) AS cv, count(*) AS s, count(*) FILTER (v > 0) AS presence_count,
   (max(nv) + 1e-12) / (coalesce(min(nv) FILTER (nv > 0), 1e-12) + 1e-12) AS max_fold_change FROM ln GROUP BY ALL HAVING count(*) FILTER (v > 0) > 0),
 g2 AS (SELECT *, CASE WHEN presence_count < s AND presence_count <= s / 2 THEN 'new_mz_signal' WHEN presence_count < s THEN 'missing_mz_signal' WHEN cv > 0.25 THEN 'common_but_changed' ELSE 'unstable_low_confidence' END AS difference_type,
   cv / (1 + cv) * ln(1 + mean_intensity) + CASE WHEN presence_count < s THEN 0.5 ELSE 0 END AS ranking_score FROM g1),
 g3 AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY ranking_score DESC, bin_index) AS k FROM g2),
 g4 AS (SELECT DISTINCT peak_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS held, false AS ok FROM g3 UNION ALL
        SELECT peak_id, k, CASE WHEN ok THEN list_append(held, bin_mz) ELSE held END, ok FROM (
          SELECT g.peak_id, g.k, held, g.bin_mz, len(held) < 20 AND len(list_filter(held, lambda q: abs(q - g.bin_mz) < 1.0)) = 0 AS ok FROM g4 JOIN g3 g ON g.peak_id = g4.peak_id AND g.k = g4.k + 1)),
 chg AS (SELECT g3.*, CAST(row_number() OVER (PARTITION BY g3.peak_id ORDER BY g3.k) AS INT) AS candidate_rank FROM g3 JOIN g4 ON g4.ok AND g4.peak_id = g3.peak_id AND g4.k = g3.k)"""
register(
    "changed_mz",
    f"""{CHANGED_SQL} SELECT peak_id, CAST(bin_index AS INT) AS bin_index, round(bin_mz, 6) AS bin_mz, round(mean_intensity, 5) AS mean_intensity, round(cv, 6) AS cv, presence_count, round(max_fold_change, 4) AS max_fold_change,
      difference_type, round(ranking_score, 6) AS ranking_score, candidate_rank FROM chg""",
)

FEATURES_SQL = f"""{CHANGED_SQL}, cd AS (SELECT peak_id, candidate_rank, bin_mz AS target_mz FROM chg),
 ns AS (SELECT peak_id, c.sample_id, c.scan_id, c.rt + local_shift AS rt FROM c JOIN la USING (sample_id) JOIN pk USING (peak_id) WHERE c.rt + local_shift BETWEEN rt_start - 0.45 AND rt_end + 0.45),
 ht AS (SELECT peak_id, candidate_rank, sample_id, scan_id, sum(intensity) AS v, CASE WHEN sum(intensity) > 0 THEN sum(mz * intensity) / sum(intensity) END AS om FROM p JOIN cd ON abs(mz - target_mz) <= 0.5 GROUP BY ALL),
 t1 AS (SELECT ns.peak_id, cd.candidate_rank, cd.target_mz, ns.sample_id, ns.rt, coalesce(v, 0) AS v, coalesce(om, target_mz) AS om, row_number() OVER (PARTITION BY ns.peak_id, cd.candidate_rank, ns.sample_id ORDER BY ns.rt) AS i
        FROM ns JOIN cd USING (peak_id) LEFT JOIN ht ON ht.peak_id = ns.peak_id AND ht.candidate_rank = cd.candidate_rank AND ht.sample_id = ns.sample_id AND ht.scan_id = ns.scan_id),
 t2 AS (SELECT peak_id, candidate_rank, target_mz, sample_id, quantile_cont(v, 0.4) AS q4, quantile_cont(v, 0.1) AS q1, max(v) AS height, arg_min(i, struct_pack(h := -v, i := i)) AS apex, count(*) AS n,
          list(v ORDER BY i) AS v, list(rt ORDER BY i) AS r, list(om ORDER BY i) AS om FROM t1 GROUP BY ALL),
 t3 AS (SELECT *, greatest(coalesce(list_median(list_filter(v, lambda q: q <= q4 + 1e-9)), 0), q1, 1e-9) AS noise FROM t2),
 t4 AS (SELECT *, height >= greatest(noise * 3, height * 0.02) AS detected FROM t3),
 t5 AS (SELECT *, greatest(noise, height * CASE WHEN detected THEN 0.02 ELSE 0.005 END) AS level FROM t4),
 t6 AS (SELECT *, coalesce(list_max(list_filter(range(1, apex + 1), lambda j: v[j] <= level)), 1) AS l0, coalesce(list_min(list_filter(range(apex, n + 1), lambda j: v[j] <= level)), n) AS r0 FROM t5),
 t7 AS (SELECT *, CASE WHEN r0 <= l0 THEN greatest(1, apex - 1) ELSE l0 END AS lf, CASE WHEN r0 <= l0 THEN least(n, apex + 1) ELSE r0 END AS rg FROM t6),
 t8 AS (SELECT peak_id, candidate_rank, sample_id, list_sum(list_transform(range(lf, rg + 1), lambda j: om[j] * v[j])) / nullif(list_sum(v[lf:rg]), 0) AS mz, r[lf] AS rt_start, r[apex] AS rt_apex, r[rg] AS rt_end,
          coalesce(list_sum(list_transform(range(lf + 1, rg + 1), lambda j: (v[j] + v[j - 1]) / 2 * (r[j] - r[j - 1]))), 0) AS area, height, height / noise AS signal_to_noise, CASE WHEN detected THEN 'matched' ELSE 'gap_filled' END AS match_status FROM t7),
 ft AS (SELECT cd.peak_id, cd.candidate_rank, cd.target_mz, s.sample_id, coalesce(mz, target_mz) AS mz, rt_start, rt_apex, rt_end, coalesce(area, 0) AS area, coalesce(height, 0) AS height, coalesce(signal_to_noise, 0) AS signal_to_noise, coalesce(match_status, 'missing') AS match_status
        FROM cd CROSS JOIN (SELECT DISTINCT sample_id FROM c) s LEFT JOIN t8 ON t8.peak_id = cd.peak_id AND t8.candidate_rank = cd.candidate_rank AND t8.sample_id = s.sample_id)""".replace("list_median(", "list_aggregate(").replace("q <= q4 + 1e-9))", "q <= q4 + 1e-9), 'median')")
register(
    "peak_features",
    f"""{FEATURES_SQL} SELECT peak_id, candidate_rank, round(target_mz, 6) AS target_mz, sample_id, round(mz, 6) AS mz, round(rt_start, 6) AS rt_start, round(rt_apex, 6) AS rt_apex, round(rt_end, 6) AS rt_end, round(area, 3) AS area, height,
      round(least(signal_to_noise, 1e9), 4) AS signal_to_noise, match_status FROM ft""",
)

PFG_SQL = f"""{FEATURES_SQL},
 b1 AS (SELECT peak_id, candidate_rank, target_mz, coalesce(sum(mz * height) FILTER (match_status = 'matched') / nullif(sum(height) FILTER (match_status = 'matched'), 0), avg(mz) FILTER (match_status = 'matched'), target_mz) AS representative_mz,
          median(rt_apex) FILTER (match_status = 'matched') AS rt FROM ft GROUP BY peak_id, candidate_rank, target_mz),
 b2 AS (SELECT b1.* EXCLUDE (rt), coalesce(last_value(rt IGNORE NULLS) OVER (PARTITION BY b1.peak_id ORDER BY candidate_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), rt_apex) AS representative_rt FROM b1 JOIN pk USING (peak_id)),
 b3 AS (SELECT ft.*, representative_mz, representative_rt, abs(mz - representative_mz) AS dm, abs(ft.rt_apex - representative_rt) AS dr FROM ft JOIN b2 USING (peak_id, candidate_rank)),
 b4 AS (SELECT *, 0.7 * greatest(0, 1 - dm / 0.5) + 0.3 * greatest(0, 1 - coalesce(dr, 0.12) / 0.12) AS match_score FROM b3),
 b5 AS (SELECT * EXCLUDE (match_status), CASE WHEN match_status = 'matched' AND match_score < 0.3 AND NOT (dm <= 0.5 AND coalesce(dr, 0.35) <= 0.35) THEN 'low_score' ELSE match_status END AS match_status FROM b4),
 b6 AS (SELECT *, ln(1 + greatest(0, area / CASE WHEN sum(area) OVER w = 0 THEN 1 ELSE sum(area) OVER w END * 1e6)) AS nv FROM b5 WINDOW w AS (PARTITION BY peak_id, candidate_rank)),
 b7 AS (SELECT peak_id, candidate_rank, target_mz, representative_mz, representative_rt, CAST(count(*) FILTER (match_status = 'matched') AS INT) AS sample_count, CAST(count(*) AS INT) AS s, count(*) FILTER (area > 0) AS positive,
          CASE WHEN count(*) > 1 AND avg(nv) > 0 THEN stddev_pop(nv) / avg(nv) ELSE 0 END AS cv, (max(nv) + 1e-12) / (coalesce(min(nv) FILTER (nv > 0), 1e-12) + 1e-12) AS max_fold_change, max(area) AS max_area,
          {', '.join(f"max({c}) FILTER (sample_id = '{x}') AS {d}_{x}" for c, d in (('area', 'area'), ('match_score', 'match')) for x in 'ANR')} FROM b6 GROUP BY ALL),
 pfg AS (SELECT *, 1 / (1 + cv) AS similarity_score, 1 - 1 / (1 + cv) AS difference_score, ln(1 + max_area) AS abundance_score, (1 - 1 / (1 + cv)) * (1 + 0.8 * ln(1 + max_area)) AS abundance_weighted_score,
          CASE WHEN sample_count = 0 OR positive = 0 THEN 'low_confidence' WHEN sample_count < s THEN 'presence_absence' WHEN 1 / (1 + cv) < 0.6 THEN 'area_changed' WHEN 1 / (1 + cv) < 0.8 THEN 'moderate_difference' ELSE 'common_feature' END AS difference_type,
          s - sample_count AS missing_sample_count, format('{{}}_FG_{{:04d}}', peak_id, candidate_rank) AS feature_group_id FROM b7)"""
PFG = {"target_mz": 6, "representative_mz": 6, "representative_rt": 6, "cv": 6, "max_fold_change": 4, "max_area": 3, "similarity_score": 6, "difference_score": 6, "abundance_score": 6, "abundance_weighted_score": 5} | {f"{c}_{x}": d for c, d in (("area", 3), ("match", 6)) for x in "ANR"}
PFG_COLUMNS = "peak_id, candidate_rank, sample_count, missing_sample_count, difference_type, feature_group_id, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in PFG.items())
register("peak_feature_groups", f"{PFG_SQL} SELECT {PFG_COLUMNS} FROM pfg")
register("nearest_group", f"{PFG_SQL} SELECT {PFG_COLUMNS} FROM pfg ORDER BY abs(pfg.representative_mz - 700), pfg.feature_group_id LIMIT 1")

GLOBAL_SQL = f"""{PFG_SQL},
 w1 AS (SELECT *, difference_score * (1 + 0.8 * CASE WHEN max(abundance_score) OVER () > 0 THEN abundance_score / max(abundance_score) OVER () ELSE 0 END) AS ranking_score FROM pfg),
 w2 AS (SELECT *, row_number() OVER (ORDER BY ranking_score DESC, difference_score DESC, max_area DESC, representative_rt, feature_group_id) AS k FROM w1),
 w3 AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(k BIGINT, m DOUBLE, t DOUBLE)[]) AS heads, CAST(NULL AS BIGINT) AS lead UNION ALL
        SELECT k, CASE WHEN near IS NULL THEN list_append(heads, struct_pack(k := k, m := m, t := t)) ELSE heads END, coalesce(near, k) FROM (
          SELECT w2.k, heads, w2.representative_mz AS m, w2.representative_rt AS t, list_filter(heads, lambda q: abs(w2.representative_mz - q.m) <= 1.0 AND abs(w2.representative_rt - q.t) <= 0.8)[1].k AS near FROM w3 JOIN w2 ON w2.k = w3.k + 1)),
 w4 AS (SELECT lead, max(ranking_score) AS ranking_score, max(difference_score) AS difference_score, max(max_area) AS max_area, max(max_fold_change) AS max_fold_change, CAST(count(*) AS INT) AS merged_feature_count,
          list_sort(list(DISTINCT feature_group_id)) AS merged_feature_group_ids, list_sort(list(DISTINCT CAST(peak_id AS VARCHAR))) AS merged_peak_ids FROM w2 JOIN w3 USING (k) GROUP BY lead),
 glo AS (SELECT w2.feature_group_id, w2.peak_id, w2.representative_mz, w2.representative_rt, w4.difference_score, w4.ranking_score, w4.max_area, w4.max_fold_change, w2.difference_type, w2.sample_count, merged_feature_count, merged_feature_group_ids, merged_peak_ids,
          row_number() OVER (ORDER BY w4.ranking_score DESC, w4.difference_score DESC, w4.max_area DESC, w2.k) AS global_rank FROM w4 JOIN w2 ON w2.k = w4.lead)"""
register(
    "global_features",
    f"""{GLOBAL_SQL} SELECT feature_group_id, peak_id, round(representative_mz, 6) AS representative_mz, round(representative_rt, 6) AS representative_rt, round(difference_score, 6) AS difference_score, round(ranking_score, 6) AS ranking_score, round(max_area, 3) AS max_area,
      round(max_fold_change, 4) AS max_fold_change, difference_type, sample_count, merged_feature_count, array_to_string(merged_feature_group_ids, '|') AS merged_feature_group_ids, array_to_string(merged_peak_ids, '|') AS merged_peak_ids FROM glo WHERE global_rank <= 500""",
)

# --- regions of the grid ---------------------------------------------------------------------------------------------
REGIONS_SQL = f"""{scores_sql(GRID)}, rg AS (SELECT *, 1 - score AS diff FROM sc WHERE score < 0.75), qq AS (SELECT coalesce(quantile_cont(mean, 0.9) FILTER (mean > 0), 0) AS q FROM rg),
 rw AS (SELECT mz_index, rt_index, max_intensity, score, {GRID.rt_min} + (rt_index + 0.5) * {GRID.rt_step!r} AS rt, {GRID.mz_min} + (mz_index + 0.5) * {GRID.mz_step!r} AS mz, round(diff, 9) AS difference_score,
   CASE WHEN present > 0 AND present < 3 THEN 'new_signal' WHEN fold >= 1.5 THEN 'intensity_increased' ELSE 'uncertain' END AS difference_type, CASE WHEN present < 3 THEN 'presence_absence' ELSE 'high_confidence' END AS signal_status,
   round(CASE WHEN q > 0 AND mean > 0 THEN least(1, sqrt(mean / q)) ELSE 0 END * diff, 9) AS weighted_difference_score FROM rg, qq),
 rk AS (SELECT *, row_number() OVER (ORDER BY weighted_difference_score DESC, difference_score DESC, max_intensity DESC, mz_index, rt_index) AS k FROM rw),
 dk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, r BIGINT, m BIGINT)[]) AS held UNION ALL
        SELECT n + 1, list_append(any_value(held), arg_min(struct_pack(k := rk.k, r := CAST(rt_index AS BIGINT), m := CAST(mz_index AS BIGINT)), rk.k))
        FROM dk JOIN rk ON len(list_filter(held, lambda q: abs(q.r - rk.rt_index) <= {2 * GRID.rt_radius} AND abs(q.m - rk.mz_index) <= {2 * GRID.mz_radius})) = 0 WHERE n < 80 GROUP BY n),
 dr AS (SELECT rk.*, CAST(u.j AS INT) AS region_rank FROM (SELECT arg_max(held, n) AS held FROM dk), range(1, len(held) + 1) u(j) JOIN rk ON rk.k = held[u.j].k)"""
REGION = "CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, round(rt, 6) AS rt, round(mz, 6) AS mz, difference_type, round(weighted_difference_score, 5) AS weighted_difference_score"
register("distinct_regions", f"{REGIONS_SQL} SELECT {REGION}, max_intensity, round(score, 5) AS score, signal_status, region_rank FROM dr")
register(
    "auto_region_matrix",
    f"""{REGIONS_SQL}, wide AS (SELECT mz_index, rt_index, {', '.join(f"max(raw) FILTER (sample_id = '{x}') AS {x}_raw, max(nv) FILTER (sample_id = '{x}') AS {x}_nv" for x in 'ANR')} FROM nr GROUP BY ALL)
 SELECT format('AUTO_{{:05d}}', region_rank) AS region_id, 'cohort:all_samples:tic_log1p' AS heatmap_id, region_rank AS source_rank, {REGION.replace('mz_index', 'dr.mz_index', 1).replace('rt_index', 'dr.rt_index', 1)},
   {', '.join(f"coalesce({x}_raw, 0) AS {x}_raw, round(coalesce({x}_nv, 0), 6) AS {x}_normalized, coalesce({x}_raw, 0) > 0 AS {x}_present" for x in 'ANR')} FROM dr LEFT JOIN wide ON wide.mz_index = dr.mz_index AND wide.rt_index = dr.rt_index""",
)

# --- the whole peak-first comparison: aligned points take the place of the points, its candidates that of the fixed peaks ---
ORACLE["peak_first_scores"] = f"""WITH RECURSIVE p0 AS ({DUCK_POINTS}), al AS (WITH RECURSIVE p AS (FROM p0), {ALIGN_SQL} SELECT sample_id, rt_shift FROM alg),
 p AS (SELECT p0.* REPLACE (p0.rt + rt_shift AS rt) FROM p0 JOIN al USING (sample_id)), {CURVE}, cv AS (SELECT sample_id AS g, rt, tic AS v FROM c), {merged_sql('cv')},
 u1 AS (SELECT peak_id, c.sample_id, c.rt, tic AS v FROM c JOIN cand ON c.rt BETWEEN rt_start - 0.08 AND rt_end + 0.08),
 u2 AS (SELECT *, (lag(v) OVER w + v) / 2 * (rt - lag(rt) OVER w) AS step FROM u1 WINDOW w AS (PARTITION BY peak_id, sample_id ORDER BY rt)),
 u3 AS (SELECT peak_id, sample_id, coalesce(sum(step), 0) AS area FROM u2 GROUP BY ALL),
 u4 AS (SELECT peak_id, s.sample_id, coalesce(u3.area, 0) AS area FROM cand CROSS JOIN (SELECT DISTINCT sample_id FROM c) s LEFT JOIN u3 USING (peak_id, sample_id)),
 u5 AS (SELECT *, max(area) OVER (PARTITION BY peak_id) AS m FROM u4),
 u6 AS (SELECT peak_id, count(*) FILTER (area >= m * 0.02 AND area > 0) AS k, count(*) AS n, any_value(m) AS m, CASE WHEN count(*) FILTER (area > 0) > 1 THEN stddev_pop(area) FILTER (area > 0) / avg(area) FILTER (area > 0) ELSE 0 END AS cv FROM u5 GROUP BY peak_id),
 u7 AS (SELECT peak_id, ln(1 + m) * (1 + 1.5 * CASE WHEN k < n AND m > 0 THEN greatest(1 - 1 / (1 + cv), 0.5) ELSE 1 - 1 / (1 + cv) END) AS tic_selection_score FROM u6),
 pk AS (SELECT cand.peak_id, rt_start, rt_apex, rt_end, width, tic_selection_score FROM cand JOIN u7 USING (peak_id) WHERE status = 'confirmed_peak' ORDER BY tic_selection_score DESC, area DESC, peak_id LIMIT 60),
 s1 AS (WITH RECURSIVE {CHROMSIM_SQL.replace(f'{CURVE}, {PEAKS_SQL},', '', 1)} SELECT * FROM sim),
 s2 AS (WITH RECURSIVE {SPECTRUM_SQL.replace(f'{CURVE}, {PEAKS_SQL},', '', 1)} SELECT peak_id, cs1 AS cosine_score, o AS overlap, ra AS relative, pa AS presence, spectrum_score FROM ss),
 fin AS (SELECT *, 0.55 * shape_score + 0.25 * area_score + 0.1 * apex_score + 0.1 * width_score AS chromatogram_score, 0.15 * shape_score + 0.1 * area_score + 0.05 * apex_score + 0.05 * width_score + 0.65 * spectrum_score AS total FROM pk JOIN s1 USING (peak_id) JOIN s2 USING (peak_id))
 SELECT peak_id, round(rt_start, 6) AS rt_start, round(rt_apex, 6) AS rt_apex, round(rt_end, 6) AS rt_end, round(tic_selection_score, 6) AS tic_selection_score, round(chromatogram_score, 6) AS chromatogram_score, round(spectrum_score, 6) AS spectrum_score,
   round(total, 6) AS peak_consistency_score, CASE WHEN capped THEN 'possible_rt_shift' WHEN chromatogram_score >= 0.9 AND spectrum_score >= 0.9 AND presence >= 0.9 THEN 'high_consistency'
     WHEN chromatogram_score >= 0.9 AND spectrum_score < 0.85 THEN 'chromatogram_consistent_spectrum_changed' WHEN chromatogram_score < 0.85 THEN 'chromatogram_changed'
     WHEN spectrum_score < 0.85 OR overlap < 0.8 OR presence < 0.85 OR relative < 0.8 THEN 'need_local_rt_mz_analysis' ELSE 'moderate_consistency' END AS status FROM fin"""
