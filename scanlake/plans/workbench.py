"""Registered queries of what screens and exports show, and the whole grid payload as artifact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import grid as G
from scanlake.operators import views as V
from scanlake.plans import catalogue as K
from scanlake.plans import greedy_sql as S
from scanlake.plans.matrices import feature_matrix
from scanlake.plans.peak_first import pinned

SAMPLES = ("A", "N", "R")
HEATMAP = "cohort:all_samples_tic_log1p"


def query(sql: str):
    def register(fn):
        K.QUERIES[fn.__name__] = fn
        S.register(fn.__name__, sql)
        return fn

    return register


def every(df: DataFrame, digits: int = 6, **own) -> DataFrame:
    """df with its doubles rounded."""
    return K.rounded(df, **({c: digits for c, kind in df.dtypes if kind == "double"} | own))


#: Windows that a user asks for, some open, some upside down, some of no width.
WANTED = """SELECT CAST(n_nationkey AS INT) AS n, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey * 2.5 AS DOUBLE) END AS rt_min, CASE WHEN n_nationkey % 7 = 3 THEN CAST(n_nationkey * 2.5 AS DOUBLE) ELSE CAST(60 - n_nationkey * 2 AS DOUBLE) END AS rt_max,
  CAST(100 + n_nationkey * 90 AS DOUBLE) AS mz_min, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE CAST(2100 - n_nationkey * 60 AS DOUBLE) END AS mz_max FROM {nation}"""


def _wanted(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("scanlake_nation")
    return spark.sql(WANTED.format(nation="scanlake_nation"))


def _clamp_sql(g: G.Grid) -> str:
    cut = lambda x, low, high, other: f"coalesce(greatest({low}::DOUBLE, least({high}::DOUBLE, {x})), {other}::DOUBLE)"
    side = lambda c, low, high: f"least({cut(c + '_min', low, high, low)}, {cut(c + '_max', low, high, high)}) AS {c}a, greatest({cut(c + '_min', low, high, low)}, {cut(c + '_max', low, high, high)}) AS {c}b"
    return f"wn AS ({WANTED.format(nation='nation')}), wc AS (SELECT *, {side('rt', g.rt_min, g.rt_max)}, {side('mz', g.mz_min, g.mz_max)} FROM wn)"


@query(
    f"""{_clamp_sql(K.GRID)} SELECT n, rt_min, rt_max, mz_min, mz_max, rta AS low_rt, CASE WHEN rtb <= rta THEN least({K.GRID.rt_max}, rta + {K.GRID.rt_step!r}) ELSE rtb END AS high_rt,
      mza AS low_mz, CASE WHEN mzb <= mza THEN least({K.GRID.mz_max}, mza + {K.GRID.mz_step!r}) ELSE mzb END AS high_mz FROM wc"""
)
def zoom_bounds(spark, sf_dir):
    return V.zoom_bounds(_wanted(spark, sf_dir), K.GRID)


def _index_sql(c, low, step, n):
    start = f"greatest(0, least({n - 1}, floor(({c}a - {low}) / {step!r}::DOUBLE)))"
    return f"CAST({start} AS INT) AS {c}_offset, CAST(greatest({start} + 1, least({n}, floor(({c}b - {low} + {step!r}::DOUBLE - 1e-12) / {step!r}::DOUBLE) + 1)) - {start} AS INT) AS {c}_count"


@query(
    f"""{_clamp_sql(K.GRID)}, wi AS (SELECT n, {_index_sql('rt', K.GRID.rt_min, K.GRID.rt_step, K.GRID.rt_bins)}, {_index_sql('mz', K.GRID.mz_min, K.GRID.mz_step, K.GRID.mz_bins)} FROM wc)
      SELECT *, {', '.join(f"round({low} + {c}_offset * {step!r}::DOUBLE, 6) AS window_{c}_min, round({low} + ({c}_offset + {c}_count) * {step!r}::DOUBLE, 6) AS window_{c}_max" for c, low, step in (('rt', K.GRID.rt_min, K.GRID.rt_step), ('mz', K.GRID.mz_min, K.GRID.mz_step)))} FROM wi"""
)
def window_offsets(spark, sf_dir):
    return every(V.index_bounds(_wanted(spark, sf_dir), K.GRID).drop("rt_min", "rt_max", "mz_min", "mz_max"))


@query(f"{S.BEST_SQL}, {S.GROUPS_SQL} SELECT feature_group_id, difference_type, CAST(row_number() OVER (ORDER BY difference_type = 'common_feature', round(confidence_score, 9) DESC, representative_rt, feature_group_id) AS INT) AS group_rank FROM fgr")
def feature_group_order(spark, sf_dir):
    return V.group_order(K._groups(spark, sf_dir)).select("feature_group_id", "difference_type", "group_rank")


PAIR_SQL = f"""{K.near_sql(K.GRID)}, pr AS (SELECT mz_index, rt_index, coalesce(max(raw) FILTER (sample_id = 'A'), 0) AS r0, coalesce(max(raw) FILTER (sample_id = 'R'), 0) AS r1, coalesce(max(nv) FILTER (sample_id = 'A'), 0) AS n0, coalesce(max(nv) FILTER (sample_id = 'R'), 0) AS n1 FROM nr GROUP BY ALL),
 ps AS (SELECT *, 1 - abs(n0 - n1) / (n0 + n1 + 1e-9) AS score, (n1 + 1e-12) / (n0 + 1e-12) AS fold FROM pr WHERE r0 > 0 OR r1 > 0)"""
PAIR_TYPE = "CASE WHEN r0 <= 0 AND r1 > 0 THEN 'new_signal' WHEN r0 > 0 AND r1 <= 0 THEN 'missing_signal' WHEN score > 0.75 THEN 'uncertain' WHEN fold >= 1.5 THEN 'intensity_increased' WHEN fold <= 1 / 1.5 THEN 'intensity_decreased' ELSE 'uncertain' END"
BOUNDS_SQL = ", ".join(f"round({low} + ({c}_index + 0.5) * {step!r}::DOUBLE, 6) AS {c}, round({low} + {c}_index * {step!r}::DOUBLE, 6) AS {c}_start, round({low} + ({c}_index + 1) * {step!r}::DOUBLE, 6) AS {c}_end" for c, low, step in (("rt", K.GRID.rt_min, K.GRID.rt_step), ("mz", K.GRID.mz_min, K.GRID.mz_step)))


@query(
    f"""{PAIR_SQL} SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, {BOUNDS_SQL}, round(score, 6) AS score, round(1 - score, 6) AS difference_score, round(n0, 6) AS reference_intensity, round(n1, 6) AS sample_intensity,
      r0 AS reference_raw_intensity, r1 AS sample_raw_intensity, greatest(r0, r1) AS max_intensity, concat_ws('|', CASE WHEN r0 > 0 THEN 'A' END, CASE WHEN r1 > 0 THEN 'R' END) AS sample_presence, round((n0 + n1) / 2, 6) AS group_mean_intensity,
      round(least(fold, 1e6), 4) AS fold_change, {PAIR_TYPE} AS difference_type, false AS saved_as_feature FROM ps"""
)
def pair_regions(spark, sf_dir):
    """fold_change is cut at 10^6: over nothing it has no digits to compare."""
    x = V.pair_regions(G.pair_scores(K._near(spark, sf_dir), "A", "R"), K.GRID, "A", "R")
    return every(x.withColumn("fold_change", F.least(F.lit(1e6), F.col("fold_change"))), fold_change=4)


DISPLAY_SQL = """dv AS (SELECT 'similarity' AS mode, score AS value FROM {cells} UNION ALL SELECT 'difference', {diff} FROM {cells}
  UNION ALL SELECT 'raw_intensity', v FROM (SELECT sum(raw) / {n} AS v FROM nr {where} GROUP BY mz_index, rt_index HAVING max(raw) > 0) UNION ALL SELECT 'normalized_intensity', v FROM (SELECT sum(nv) / {n} AS v FROM nr {where} GROUP BY mz_index, rt_index HAVING max(nv) > 0)),
 dq AS (SELECT mode, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high, count(*) AS valid FROM dv GROUP BY mode)"""
CELLS = K.GRID.rt_bins * K.GRID.mz_bins


@query(f"{K.scores_sql(K.GRID)}, {DISPLAY_SQL.format(cells='sc', diff='1 - score', where='', n=3)} SELECT mode, round(low, 5) AS low, round(high, 5) AS high, valid, {CELLS} - valid AS null_count FROM dq")
def color_domain(spark, sf_dir):
    near = K._near(spark, sf_dir)
    return every(V.color_domain(V.display_values(G.cohort_scores(near), near), K.GRID), 5)


@query(
    f"""{PAIR_SQL}, {DISPLAY_SQL.format(cells='ps', diff='CASE WHEN n1 >= n0 THEN 1 - score ELSE score - 1 END', where="WHERE sample_id IN ('A', 'R')", n=2)}
      SELECT mode, round(CASE WHEN mode = 'difference' THEN -greatest(abs(low), abs(high), 1e-6) ELSE low END, 5) AS low, round(CASE WHEN mode = 'difference' THEN greatest(abs(low), abs(high), 1e-6) ELSE high END, 5) AS high, valid, {CELLS} - valid AS null_count FROM dq"""
)
def pair_color_domain(spark, sf_dir):
    near = K._near(spark, sf_dir)
    return every(V.color_domain(V.display_values(G.pair_scores(near, "A", "R"), near.where("sample_id IN ('A', 'R')"), True), K.GRID, True), 5)


#: The first 20 regions as records: traces are the scans nearest in aligned RT.
SAVE_SQL = f"""{S.REGIONS_SQL}, tg AS (SELECT * FROM dr WHERE region_rank <= 20),
 al AS (WITH RECURSIVE {S.ALIGN_SQL} SELECT sample_id, rt_shift FROM alg), {K.CURVE},
 ct AS (SELECT tg.mz_index, tg.rt_index, c.sample_id, arg_min(struct_pack(scan_id := scan_id, raw_rt := c.rt, aligned_rt := c.rt + rt_shift), struct_pack(d := abs(c.rt + rt_shift - tg.rt), r := c.rt, s := scan_id)) AS t FROM tg CROSS JOIN c JOIN al USING (sample_id) GROUP BY ALL),
 cx AS (SELECT mz_index, rt_index, {', '.join(f"coalesce(max(raw) FILTER (sample_id = '{x}'), 0) AS {x}_raw, coalesce(max(nv) FILTER (sample_id = '{x}'), 0) AS {x}_nv" for x in SAMPLES)}, CASE WHEN count(*) FILTER (nv > 0) >= 2 THEN (max(nv) + 1e-12) / (min(nv) FILTER (nv > 0) + 1e-12) ELSE 1 END AS fold,
          array_to_string(list(sample_id ORDER BY sample_id) FILTER (raw > 0), '|') AS sample_presence, count(*) FILTER (raw > 0) AS np FROM nr GROUP BY ALL),
 sv AS (SELECT format('LCMSF_{{:05d}}', region_rank) AS feature_id, '{HEATMAP}' AS heatmap_id, region_rank, tg.mz_index, tg.rt_index, rt, mz, score, weighted_difference_score, fold, coalesce(sample_presence, '') AS sample_presence,
          CASE WHEN np > 0 AND np < 3 THEN 'new_signal' WHEN fold >= 1.5 THEN 'intensity_increased' WHEN fold <= 1 / 1.5 THEN 'intensity_decreased' ELSE 'uncertain' END AS difference_type, {', '.join(f'{x}_raw, {x}_nv' for x in SAMPLES)}
        FROM tg JOIN cx ON cx.mz_index = tg.mz_index AND cx.rt_index = tg.rt_index)"""


def _alignment_shifts(spark, sf_dir):
    return pinned(K._alignment(spark, sf_dir).select("sample_id", "rt_shift"))


def _saved(spark, sf_dir):
    near = K._near(spark, sf_dir)
    top = pinned(G.distinct_regions(K._ordered_regions(near), K.GRID).where("region_rank <= 20"))
    trace = V.traces(K.scans(spark, sf_dir), K.points(spark, sf_dir), _alignment_shifts(spark, sf_dir), top, V.mz_tolerance_of(K.GRID))
    return pinned(V.cell_features(top, near, trace, K.GRID, HEATMAP)), trace


RECORD = f"feature_id, heatmap_id, round(rt, 6) AS aligned_rt, {BOUNDS_SQL.split(' AS rt, ', 1)[1]}, round(score, 5) AS similarity_score, round(1 - score, 5) AS difference_score, round(weighted_difference_score, 5) AS weighted_difference_score, sample_presence, round(fold, 4) AS fold_change, difference_type"


@query(f"{SAVE_SQL} SELECT {RECORD} FROM sv WHERE region_rank % 3 <> 0")
def save_top_regions(spark, sf_dir):
    """Every third region is saved already and is not saved again."""
    features, _ = _saved(spark, sf_dir)
    old = features.where("CAST(substring(feature_id, 7) AS INT) % 3 = 0").select("heatmap_id", (F.col("aligned_rt") + 1e-12).alias("aligned_rt"), "mz")
    return every(V.not_saved(features, old).drop("sample_intensities", "source_scans"), similarity_score=5, difference_score=5, weighted_difference_score=5, fold_change=4)


@query(
    f"""{SAVE_SQL} SELECT sv.feature_id, round(rt, 6) AS aligned_rt, round(mz, 6) AS mz, difference_type,
      {', '.join(f"{x}_raw, round({x}_nv, 6) AS {x}_normalized, CASE WHEN {x}_raw > 0 THEN 'present' ELSE 'missing' END AS {x}_status, t{x}.t.scan_id AS {x}_scan_id, t{x}.t.raw_rt AS {x}_raw_rt, round(t{x}.t.aligned_rt, 6) AS {x}_aligned_rt" for x in SAMPLES)}
      FROM sv {' '.join(f"JOIN ct t{x} ON t{x}.sample_id = '{x}' AND t{x}.mz_index = sv.mz_index AND t{x}.rt_index = sv.rt_index" for x in SAMPLES)}"""
)
def saved_feature_matrix(spark, sf_dir):
    """The records go through JSON, as the store keeps them."""
    features, _ = _saved(spark, sf_dir)
    saved = features.select("feature_id", F.to_json(F.struct("aligned_rt", "mz", "difference_type", "sample_intensities", "source_scans")).alias("feature_json"))
    return every(feature_matrix(saved, list(SAMPLES)))


@query(
    f"""{SAVE_SQL}, hx AS (SELECT ct.mz_index, ct.rt_index, ct.sample_id, sum(intensity) AS v FROM ct JOIN tg USING (mz_index, rt_index) JOIN p ON p.sample_id = ct.sample_id AND p.scan_id = ct.t.scan_id AND abs(p.mz - tg.mz) <= {V.mz_tolerance_of(K.GRID)!r} GROUP BY ALL)
      SELECT CAST(ct.mz_index AS INT) AS mz_index, CAST(ct.rt_index AS INT) AS rt_index, ct.sample_id, t.scan_id AS scan_id, t.raw_rt AS raw_rt, round(t.aligned_rt, 6) AS aligned_rt, round(abs(t.aligned_rt - tg.rt), 6) AS rt_delta, coalesce(v, 0) AS intensity
      FROM ct JOIN tg USING (mz_index, rt_index) LEFT JOIN hx USING (mz_index, rt_index, sample_id)"""
)
def cell_traces(spark, sf_dir):
    return every(_saved(spark, sf_dir)[1])


@query(f"{S.GLOBAL_SQL} SELECT feature_group_id, CAST(row_number() OVER (ORDER BY global_rank) AS INT) AS feature_rank, round(representative_rt, 6) AS representative_rt, round(representative_mz, 6) AS representative_mz, round(max_area, 3) AS max_area FROM glo WHERE global_rank <= 500 AND representative_rt > 0 AND representative_mz > 0 AND max_area > 0")
def feature_map(spark, sf_dir):
    x = V.feature_map(K.C.global_features(K.C.peak_feature_groups(*K._features(spark, sf_dir))))
    return every(x.select("feature_group_id", "feature_rank", "representative_rt", "representative_mz", "max_area"), max_area=3)


@query(f"{S.GLOBAL_SQL}, ex AS (SELECT min(representative_rt) AS a, max(representative_rt) AS b, min(representative_mz) AS c, max(representative_mz) AS d FROM glo WHERE global_rank <= 500 AND max_area > 0) SELECT round(a - greatest((b - a) * 0.04, 0.05), 6) AS xmin, round(b + greatest((b - a) * 0.04, 0.05), 6) AS xmax, round(greatest(0, c - greatest((d - c) * 0.04, 1)), 6) AS ymin, round(d + greatest((d - c) * 0.04, 1), 6) AS ymax FROM ex")
def feature_map_extent(spark, sf_dir):
    return every(V.map_extent(V.feature_map(K.C.global_features(K.C.peak_feature_groups(*K._features(spark, sf_dir))))))


@query(
    f"""{S.PFG_SQL} SELECT peak_id, candidate_rank, round(representative_mz, 6) AS mz, feature_group_id, round(representative_rt, 6) AS representative_rt, sample_count AS presence_count, round((area_A + area_N + area_R) / 3, 3) AS mean_intensity, round(cv, 6) AS cv,
      round(max_fold_change, 4) AS max_fold_change, difference_type, round(difference_score, 6) AS contribution_to_spectrum_difference, round(abundance_weighted_score, 5) AS ranking_score FROM pfg WHERE candidate_rank <= 20"""
)
def changed_mz_of_groups(spark, sf_dir):
    return every(V.changes_of_groups(K.C.peak_feature_groups(*K._features(spark, sf_dir))), mean_intensity=3, max_fold_change=4, ranking_score=5)


@query(f"{S.ALIGN_SQL} SELECT sample_id, scan_idx AS scan_ord, round(p.rt + rt_shift, 6) AS rt, sum(intensity) AS value FROM p JOIN alg USING (sample_id) GROUP BY sample_id, scan_idx, p.rt, rt_shift")
def curve_in_scan_order(spark, sf_dir):
    p = K.points(spark, sf_dir).groupBy("sample_id", F.col("scan_idx").alias("scan_ord"), "rt").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpi"))
    return every(V.curve_in_scan_order(p, _alignment_shifts(spark, sf_dir)))


@query(f"{K.CHROM_SQL}, mp AS (SELECT sample_id, apex_time_min AS apex FROM peaks WHERE area_rank = 1) SELECT sample_id, round((SELECT apex FROM mp WHERE sample_id = 'A') - apex, 6) AS rt_shift FROM mp")
def realign_main_peak(spark, sf_dir):
    c = K.curves(spark, sf_dir, "bpi")
    return every(V.main_peak_shifts(K.K.main_peaks(c, K.K.chromatogram_peaks(c, ["sample_id"]), ["sample_id"]), "A"))


@query(f"{S.ALIGN_SQL} SELECT sample_id, (SELECT count(*) FROM c c2 WHERE c2.sample_id = alg.sample_id) AS scan_count, round(rt_shift, 6) AS rt_shift, round((SELECT stddev_pop(apex_rt) / avg(apex_rt) FROM alg), 9) AS main_peak_rt_cv FROM alg")
def workbench_summary(spark, sf_dir):
    a = pinned(K._alignment(spark, sf_dir))
    n = K.scans(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("scan_count"))
    return every(n.join(a.select("sample_id", "rt_shift"), "sample_id").crossJoin(F.broadcast(V.main_peak_cv(a))), main_peak_rt_cv=9)


@query(f"{K.CURVE}, sx AS (SELECT sample_id, max(intensity) AS spectrum_max FROM p WHERE mz BETWEEN 300 AND 500 GROUP BY ALL) SELECT sample_id, min(rt) AS rt_min, max(rt) AS rt_max, max(tic) AS value_max, coalesce(any_value(spectrum_max), 0) AS spectrum_max FROM c LEFT JOIN sx USING (sample_id) GROUP BY sample_id")
def view_extents(spark, sf_dir):
    return V.view_extents(K.scans(spark, sf_dir), K.points(spark, sf_dir), 300.0, 500.0)


# --- the whole payload -----------------------------------------------------------------------------------------------
def payload(points: DataFrame, scans: DataFrame, near: DataFrame, shifts: DataFrame, g: G.Grid, reference: str, per_scan: int = 180) -> dict[str, DataFrame]:
    """The grid payload as tables: chromatograms, spectra (the per_scan most intense points of each scan, by aligned RT) and heatmaps
    (comparison: the cohort and each sample against the reference), each keyed by what the store splits it by."""
    from scanlake.operators.points import top_points

    aligned = scans.join(shifts, "sample_id").withColumn("aligned_rt", F.col("rt") + F.col("rt_shift"))
    spectra = top_points(points, per_scan, list(K.ORDER)).join(shifts, "sample_id").withColumn("aligned_rt", F.col("rt") + F.col("rt_shift"))
    others = [r["sample_id"] for r in shifts.select("sample_id").distinct().orderBy("sample_id").collect() if r["sample_id"] != reference]  # a row per sample
    maps = G.cohort_scores(near).select(F.lit("cohort:all_samples").alias("comparison"), "mz_index", "rt_index", "score", "max_intensity")
    for s in others:
        maps = maps.unionByName(G.pair_scores(near, reference, s).select(F.lit(f"{reference}_vs_{s}").alias("comparison"), "mz_index", "rt_index", "score", "max_intensity"))
    return {"chromatograms": aligned.select("sample_id", "scan_id", "rt", "aligned_rt", "tic", "bpi"), "spectra": spectra.select("sample_id", "scan_id", "aligned_rt", "mz", "intensity", "point_rank"), "heatmaps": maps}


@query(
    f"""{PAIR_SQL}, pn AS (SELECT mz_index, rt_index, coalesce(max(raw) FILTER (sample_id = 'A'), 0) AS r0, coalesce(max(raw) FILTER (sample_id = 'N'), 0) AS r1, coalesce(max(nv) FILTER (sample_id = 'A'), 0) AS n0, coalesce(max(nv) FILTER (sample_id = 'N'), 0) AS n1 FROM nr GROUP BY ALL),
      co AS (SELECT sum(nv) / 3 AS mean, sqrt(greatest(sum(nv * nv) / 3 - (sum(nv) / 3) ** 2, 0)) AS sd, max(raw) AS m FROM nr GROUP BY mz_index, rt_index HAVING max(raw) > 0), {K.CURVE},
      tp AS (SELECT sample_id, intensity FROM p QUALIFY row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY intensity DESC, mz, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, price) <= 180)
      SELECT concat('chromatograms:', sample_id) AS artifact_key, count(*) AS n_rows, round(sum(tic), 3) AS total FROM c GROUP BY ALL UNION ALL SELECT concat('spectra:', sample_id), count(*), round(sum(intensity), 3) FROM tp GROUP BY ALL
      UNION ALL SELECT 'heatmap:cohort:all_samples', count(*), round(sum(CASE WHEN mean > 0 THEN 1 / (1 + sd / mean) ELSE 0 END), 3) FROM co UNION ALL SELECT 'heatmap:A_vs_R', count(*), round(sum(score), 3) FROM ps
      UNION ALL SELECT 'heatmap:A_vs_N', count(*), round(sum(1 - abs(n0 - n1) / (n0 + n1 + 1e-9)), 3) FROM pn WHERE r0 > 0 OR r1 > 0"""
)
def workbench_payload(spark, sf_dir):
    """What the payload's artifacts hold: rows and totals by key."""
    t = payload(K.points(spark, sf_dir), K.scans(spark, sf_dir), K._near(spark, sf_dir), _alignment_shifts(spark, sf_dir), K.GRID, "A")
    one = lambda x, kind, key, v: x.groupBy(F.concat(F.lit(kind + ":"), key).alias("artifact_key")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(v), 3).alias("total"))
    return one(t["chromatograms"], "chromatograms", F.col("sample_id"), "tic").unionByName(one(t["spectra"], "spectra", F.col("sample_id"), "intensity")).unionByName(one(t["heatmaps"], "heatmap", F.col("comparison"), "score"))


@query(
    f"""sh AS (WITH RECURSIVE {S.ALIGN_SQL} SELECT sample_id, rt_shift FROM alg), {PAIR_SQL}, {K.CURVE},
      pn AS (SELECT mz_index, rt_index, coalesce(max(raw) FILTER (sample_id = 'A'), 0) AS r0, coalesce(max(raw) FILTER (sample_id = 'N'), 0) AS r1, coalesce(max(nv) FILTER (sample_id = 'A'), 0) AS n0, coalesce(max(nv) FILTER (sample_id = 'N'), 0) AS n1 FROM nr GROUP BY ALL),
      co AS (SELECT mz_index, rt_index, sum(nv) / 3 AS mean, sqrt(greatest(sum(nv * nv) / 3 - (sum(nv) / 3) ** 2, 0)) AS sd, max(raw) AS m FROM nr GROUP BY mz_index, rt_index HAVING max(raw) > 0),
      tp AS (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY intensity DESC, mz, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, price) AS k FROM p QUALIFY k <= 180),
      a AS (SELECT concat('chromatograms:', sample_id) AS artifact_key, scan_id AS place, rt AS x, rt + rt_shift AS y, tic AS value, bpi AS more FROM c JOIN sh USING (sample_id)
       UNION ALL SELECT concat('spectra:', sample_id), scan_id, rt + rt_shift, mz, intensity, CAST(k AS DOUBLE) FROM tp JOIN sh USING (sample_id)
       UNION ALL SELECT 'heatmap:cohort:all_samples', concat(mz_index, '/', rt_index), mz_index, rt_index, CASE WHEN mean > 0 THEN 1 / (1 + sd / mean) ELSE 0 END, m FROM co
       UNION ALL SELECT 'heatmap:A_vs_R', concat(mz_index, '/', rt_index), mz_index, rt_index, score, greatest(r0, r1) FROM ps
       UNION ALL SELECT 'heatmap:A_vs_N', concat(mz_index, '/', rt_index), mz_index, rt_index, 1 - abs(n0 - n1) / (n0 + n1 + 1e-9), greatest(r0, r1) FROM pn WHERE r0 > 0 OR r1 > 0)
      SELECT artifact_key, place, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(y AS DOUBLE), 6) AS y, round(CAST(value AS DOUBLE), 5) AS value, round(CAST(more AS DOUBLE), 5) AS more FROM a"""
)
def workbench_payload_rows(spark, sf_dir):
    """Every row of the payload's artifacts: scans, the points kept of each, cells of the maps."""
    t = payload(K.points(spark, sf_dir), K.scans(spark, sf_dir), K._near(spark, sf_dir), _alignment_shifts(spark, sf_dir), K.GRID, "A")
    cell = F.concat_ws("/", "mz_index", "rt_index")
    parts = (("chromatograms", "sample_id", F.col("scan_id"), "rt", "aligned_rt", "tic", "bpi"), ("spectra", "sample_id", F.col("scan_id"), "aligned_rt", "mz", "intensity", "point_rank"), ("heatmaps", "comparison", cell, "mz_index", "rt_index", "score", "max_intensity"))
    out = None
    for kind, key, place, x, y, value, more in parts:
        number = lambda c, name, digits=6: F.round(F.col(c).cast("double"), digits).alias(name)
        name = F.concat(F.lit("heatmap:" if kind == "heatmaps" else kind + ":"), F.col(key)).alias("artifact_key")
        rows = t[kind].select(name, place.alias("place"), number(x, "x"), number(y, "y"), number(value, "value", 5), number(more, "more", 5))
        out = rows if out is None else out.unionByName(rows)
    return out
