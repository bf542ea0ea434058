"""Registered queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake.functions import cosine, directional_difference
from scanlake.operators import align as A
from scanlake.operators import compare as C
from scanlake.operators import grid as G
from scanlake.operators import match as M
from scanlake.operators import peaks as K
from scanlake.operators import points as P
from scanlake.operators import series as S
from scanlake.operators.shared import written
from scanlake.plans.peak_first import pinned

#: Unique order of points of one scan and intensity.
ORDER = ["mz", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "price"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Points of one sample per return flag; day numbers become scans of 0.125 minutes (FIXTURES.md, section 3).
POINTS_SQL = """
WITH base AS (
  SELECT l_returnflag AS sample_id, l_orderkey, l_linenumber, l_shipdate, {dd} AS day_idx,
         CAST(l_extendedprice AS DOUBLE) AS price, l_partkey, l_suppkey FROM {lineitem}),
g AS (SELECT *, CAST(floor(day_idx / CAST(5.0 AS DOUBLE)) AS INT) AS scan_idx,
        (l_partkey * 7919) % 180 AS k, (l_suppkey % 7) - 3 AS j,
        CASE sample_id WHEN 'A' THEN CAST(0.0 AS DOUBLE) WHEN 'N' THEN CAST(0.25 AS DOUBLE)
                       ELSE CAST(-0.375 AS DOUBLE) END AS drift FROM base),
r AS (SELECT *, CAST(scan_idx AS DOUBLE) * CAST(0.125 AS DOUBLE) AS rt FROM g)
SELECT sample_id, concat(sample_id, '_', CAST(scan_idx AS {str})) AS scan_id, scan_idx, rt,
  CAST(200.0 AS DOUBLE) + CAST(k * 10 AS DOUBLE) + CAST(j AS DOUBLE) / CAST(4096.0 AS DOUBLE) AS mz,
  CAST(floor(price * (CAST(0.02 AS DOUBLE)
    + CAST(1.0 AS DOUBLE)/(CAST(1.0 AS DOUBLE)+((rt-CAST(12.0 AS DOUBLE)-drift)/CAST(0.5 AS DOUBLE))*((rt-CAST(12.0 AS DOUBLE)-drift)/CAST(0.5 AS DOUBLE)))
    + CAST(0.6 AS DOUBLE)/(CAST(1.0 AS DOUBLE)+((rt-CAST(25.0 AS DOUBLE)-drift)/CAST(0.75 AS DOUBLE))*((rt-CAST(25.0 AS DOUBLE)-drift)/CAST(0.75 AS DOUBLE)))
    + CAST(0.8 AS DOUBLE)/(CAST(1.0 AS DOUBLE)+((rt-CAST(41.0 AS DOUBLE)-drift)/CAST(0.5 AS DOUBLE))*((rt-CAST(41.0 AS DOUBLE)-drift)/CAST(0.5 AS DOUBLE))))
    * (CASE WHEN sample_id = 'R' AND k % 20 = 0 THEN CAST(3.0 AS DOUBLE)
            WHEN sample_id = 'N' AND k % 30 = 7 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)) AS DOUBLE) AS intensity,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, price
FROM r
"""
DUCK_POINTS = POINTS_SQL.format(dd="date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))", lineitem="lineitem", str="VARCHAR")


def points(spark, sf_dir):
    """The driver's line items as centroid points: sample_id, scan_id, scan_idx, rt, mz, intensity and the order columns."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("scanlake_lineitem")
    return spark.sql(POINTS_SQL.format(dd="datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01')", lineitem="scanlake_lineitem", str="STRING"))


def query(sql: str | None = None):
    """Registers a query under its function's name; sql is written over a view p of points."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = f"WITH p AS ({DUCK_POINTS}) {sql}"
        return fn

    return register


@query("SELECT sample_id, scan_id, rt, sum(intensity) AS tic, max(intensity) AS bpi FROM p GROUP BY ALL")
def chromatogram_tic_bpc(spark, sf_dir):
    return points(spark, sf_dir).groupBy("sample_id", "scan_id", "rt").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpi"))


def scans(spark, sf_dir):
    """(sample_id, scan_id, rt, tic, bpi)"""
    return P.chromatogram(points(spark, sf_dir))


def curves(spark, sf_dir, value="tic"):
    return scans(spark, sf_dir).select("sample_id", "rt", F.col(value).alias("value"))


#: Common tables of the SQL counterparts: curve (scans), s (samples).
CURVE = "c AS (SELECT sample_id, scan_id, rt, sum(intensity) AS tic, max(intensity) AS bpi FROM p GROUP BY ALL)"


def r6(c, name=None):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or (c if isinstance(c, str) else "x"))


def rounded(df, **digits):
    """df with columns rounded where named; sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


#: Digits of a peak's columns.
SHAPE = {"rt_start": 6, "rt_apex": 6, "rt_end": 6, "height": 4, "body_height": 4, "area": 3, "width": 6, "prominence": 4, "snr": 5, "area_ratio": 8, "noise_level": 4}


# --- curves --------------------------------------------------------------------------------------------------------
@query("SELECT sample_id, min(mz) AS mz_min, max(mz) AS mz_max, min(rt) AS rt_min, max(rt) AS rt_max, count(DISTINCT scan_id) AS scan_count FROM p GROUP BY ALL")
def raw_file_summary(spark, sf_dir):
    return P.file_summary(points(spark, sf_dir))


@query("SELECT sample_id, scan_id, rt, count(*) AS n_points, sum(intensity) AS tic FROM p WHERE rt BETWEEN 10 AND 15 GROUP BY ALL")
def rt_window_filter(spark, sf_dir):
    x = P.rt_window(points(spark, sf_dir), 10.0, 15.0)
    return x.groupBy("sample_id", "scan_id", "rt").agg(F.count(F.lit(1)).alias("n_points"), F.sum("intensity").alias("tic"))


@query(
    "SELECT sample_id, scan_id, mz, intensity, point_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY intensity DESC, mz, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, price) AS INT) AS point_rank"
    " FROM p WHERE mz BETWEEN 300 AND 1500 AND intensity >= 10) WHERE point_rank <= 3"
)
def topk_points_per_scan(spark, sf_dir):
    return P.top_points(points(spark, sf_dir), 3, ORDER, 300.0, 1500.0, 10.0).select("sample_id", "scan_id", "mz", "intensity", "point_rank")


@query(f", {CURVE} SELECT sample_id, rt, round(avg(tic) OVER (PARTITION BY sample_id ORDER BY rt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM c")
def moving_average_truncated(spark, sf_dir):
    return S.moving_average(curves(spark, sf_dir), "value", 5, ["sample_id"], "smoothed").select("sample_id", "rt", r6("smoothed"))


#: Padded average by looking the neighbours up: indexes are clamped to the curve.
PADDED = """i AS (SELECT sample_id, rt, {v} AS v, row_number() OVER (PARTITION BY sample_id ORDER BY rt) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM c),
 y AS (SELECT a.sample_id, a.rt, a.v, a.i, a.n, sum(b.v) / 7 AS y FROM i a CROSS JOIN range(-3, 4) k(d) JOIN i b ON b.sample_id = a.sample_id AND b.i = greatest(1, least(a.n, a.i + k.d)) GROUP BY ALL)"""


@query(f", {CURVE}, {PADDED.format(v='tic')} SELECT sample_id, rt, round(y, 6) AS smoothed FROM y")
def moving_average_padded(spark, sf_dir):
    return S.padded_average(curves(spark, sf_dir), "value", 7, ["sample_id"], "smoothed").select("sample_id", "rt", r6("smoothed"))


@query(f", {CURVE} SELECT sample_id, rt, min(tic) OVER (PARTITION BY sample_id ORDER BY rt ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS baseline FROM c")
def rolling_min_baseline(spark, sf_dir):
    return S.rolling_min(curves(spark, sf_dir), "value", 41, ["sample_id"], "baseline").select("sample_id", "rt", "baseline")


BASELINE_SQL = """m AS (SELECT *, avg(tic) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM c WINDOW w AS (PARTITION BY sample_id ORDER BY rt)),
 k AS (SELECT *, greatest(sm - min(sm) OVER (PARTITION BY sample_id ORDER BY rt ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 0) AS cor FROM m),
 q AS (SELECT sample_id, quantile_cont(cor, 0.4) AS q4, quantile_cont(cor, 0.1) AS q1 FROM k GROUP BY ALL),
 l AS (SELECT sample_id, cor, q1, median(cor) OVER (PARTITION BY sample_id) AS md FROM k JOIN q USING (sample_id) WHERE cor <= q4 + 1e-9)"""


@query(f", {CURVE}, {BASELINE_SQL} SELECT sample_id, round(greatest(any_value(md) + 1.4826 * median(abs(cor - md)), any_value(q1), 1e-9), 4) AS noise_level FROM l GROUP BY ALL")
def baseline_noise(spark, sf_dir):
    return S.noise_level(S.baseline(curves(spark, sf_dir), ["sample_id"]), ["sample_id"]).select("sample_id", F.round("noise_level", 4).alias("noise_level"))


@query(
    f", {CURVE}, o AS (SELECT sample_id, tic, row_number() OVER (PARTITION BY sample_id ORDER BY tic) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM c)"
    " SELECT sample_id, round(greatest(stddev_pop(tic), median(tic) * 0.1, 1), 4) AS noise FROM o WHERE i <= greatest(3, n // 5) GROUP BY ALL"
)
def robust_noise(spark, sf_dir):
    return S.robust_noise(curves(spark, sf_dir), "value", ["sample_id"]).select("sample_id", F.round("noise", 4).alias("noise"))


@query(
    f", {CURVE}, m AS (SELECT *, median(tic) OVER (PARTITION BY sample_id) AS md FROM c)"
    " SELECT sample_id, round(quantile_cont(tic, 0.25), 4) AS q25, round(any_value(md), 4) AS median, round(median(abs(tic - md)), 4) AS mad FROM m GROUP BY ALL"
)
def quantile_median_mad(spark, sf_dir):
    x = curves(spark, sf_dir).withColumn("m", F.median("value").over(Window.partitionBy("sample_id")))
    return x.groupBy("sample_id").agg(F.round(F.expr("percentile(value, 0.25)"), 4).alias("q25"), F.round(F.max("m"), 4).alias("median"), F.round(F.median(F.abs(F.col("value") - F.col("m"))), 4).alias("mad"))


@query(
    f", {CURVE}, a AS (SELECT *, lag(rt) OVER w AS r0, lag(tic) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY sample_id ORDER BY rt))"
    " SELECT sample_id, round(coalesce(sum((t0 + tic) / 2 * (rt - r0)), 0), 4) AS plain, round(coalesce(sum((greatest(t0 - 50000, 0) + greatest(tic - 50000, 0)) / 2 * (rt - r0)), 0), 4) AS above FROM a GROUP BY ALL"
)
def trapezoid_area(spark, sf_dir):
    c = curves(spark, sf_dir)
    a, b = S.area(c, "value", ["sample_id"]), S.area(c, "value", ["sample_id"], F.lit(50000.0))
    return a.select("sample_id", F.round("area", 4).alias("plain")).join(b.select("sample_id", F.round("area", 4).alias("above")), "sample_id")


@query(
    f", {CURVE}, e AS (SELECT min(rt) AS lo, max(rt) AS hi, least(8000, greatest(100, ceil((max(rt) - min(rt)) / 0.25))) AS n FROM c),"
    " b AS (SELECT least(n - 1, greatest(0, trunc((rt - lo) / ((hi - lo) / n)))) AS k, lo, (hi - lo) / n AS st, tic FROM c, e)"
    " SELECT round(lo + (k + 0.5) * st, 6) AS rt, round(avg(tic), 4) AS value FROM b GROUP BY k, lo, st"
)
def consensus_tic(spark, sf_dir):
    return S.consensus(curves(spark, sf_dir), 0.25).select(r6("rt"), F.round("value", 4).alias("value"))


@query(
    f", {CURVE} SELECT sample_id, rt, tic AS value FROM (SELECT *, lag(tic) OVER w AS l, lead(tic) OVER w AS r FROM c WINDOW w AS (PARTITION BY sample_id ORDER BY rt)) WHERE tic >= l AND tic > r"
)
def local_maxima(spark, sf_dir):
    return S.local_maxima(curves(spark, sf_dir), "value", ["sample_id"])


# --- peaks -----------------------------------------------------------------------------------------------------------
#: Chromatogram peaks as joins: feet are the nearest points not above the level, else the ends.
CHROM_SQL = f"""{CURVE}, {PADDED.format(v='bpi')},
 bq AS (SELECT sample_id, quantile_cont(y, 0.1) AS base FROM y GROUP BY ALL),
 cc AS (SELECT y.*, base, greatest(y - base, 0) AS cor FROM y JOIN bq USING (sample_id)),
 nq AS (SELECT sample_id, greatest(quantile_cont(cor, 0.25), max(cor) * 0.01, 1) AS noise, max(cor) AS mx FROM cc GROUP BY ALL),
 nb AS (SELECT *, lag(cor) OVER w AS cl, lead(cor) OVER w AS cr, (cor + lag(cor) OVER w) / 2 * (rt - lag(rt) OVER w) AS step FROM cc JOIN nq USING (sample_id) WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
 tops AS (SELECT *, greatest(noise * 1.8, cor * 0.025) AS foot FROM nb WHERE mx > 0 AND cor >= greatest(noise * 4, mx * 0.08) AND cor >= cl AND cor > cr),
 ft AS (SELECT t.sample_id, t.i AS apex, any_value(t.base) AS base, coalesce(max(CASE WHEN b.i <= t.i AND b.cor <= t.foot THEN b.i END), 1) AS l, coalesce(min(CASE WHEN b.i >= t.i AND b.cor <= t.foot THEN b.i END), any_value(t.n)) AS r
        FROM tops t JOIN nb b ON b.sample_id = t.sample_id GROUP BY t.sample_id, t.i),
 pk AS (SELECT f.sample_id, f.apex, any_value(f.base) AS baseline, min(b.rt) AS start_time_min, max(b.rt) AS end_time_min, sum(CASE WHEN b.i > f.l THEN b.step ELSE 0 END) AS area, max(b.v) AS height,
        min_by(b.rt, struct_pack(h := -b.v, i := b.i)) AS apex_time_min FROM ft f JOIN nb b ON b.sample_id = f.sample_id AND b.i BETWEEN f.l AND f.r GROUP BY f.sample_id, f.apex),
 peaks AS (SELECT *, end_time_min - start_time_min AS width_min, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY area DESC, apex) AS INT) AS area_rank FROM pk WHERE end_time_min - start_time_min > 0.02 AND area > 0)"""


def chrom(spark, sf_dir):
    return K.chromatogram_peaks(curves(spark, sf_dir, "bpi"), ["sample_id"])


@query(f", {CHROM_SQL} SELECT sample_id, area_rank, start_time_min, apex_time_min, end_time_min, height, round(area, 3) AS area, width_min, round(baseline, 4) AS baseline FROM peaks")
def chrom_peaks(spark, sf_dir):
    return chrom(spark, sf_dir).select("sample_id", "area_rank", "start_time_min", "apex_time_min", "end_time_min", "height", F.round("area", 3).alias("area"), "width_min", F.round("baseline", 4).alias("baseline"))


@query(f", {CHROM_SQL} SELECT sample_id, start_time_min, apex_time_min, end_time_min, height, round(area, 3) AS area, 'largest_area' AS match_method FROM peaks WHERE area_rank = 1")
def main_peak(spark, sf_dir):
    c = curves(spark, sf_dir, "bpi")
    return K.main_peaks(c, K.chromatogram_peaks(c, ["sample_id"]), ["sample_id"]).withColumn("area", F.round("area", 3))


@query(
    f""", {CHROM_SQL}, ra AS (SELECT apex_time_min AS ref FROM peaks WHERE sample_id = 'A' AND area_rank = 1),
 near AS (SELECT *, apex_time_min - ref AS delta, max(area) OVER (PARTITION BY sample_id) AS ma, max(height) OVER (PARTITION BY sample_id) AS mh FROM peaks, ra WHERE abs(apex_time_min - ref) <= 3)
 SELECT sample_id, apex_time_min, delta AS reference_delta, round(area / ma * 0.55 + height / mh * 0.25 + (1 - abs(delta) / 3) * 0.2, 6) AS match_score FROM near
 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY area / ma * 0.55 + height / mh * 0.25 + (1 - abs(delta) / 3) * 0.2 DESC, area_rank) = 1"""
)
def match_reference_peak(spark, sf_dir):
    c = curves(spark, sf_dir, "bpi")
    peaks = K.chromatogram_peaks(c, ["sample_id"])
    ref = K.main_peaks(c, peaks, ["sample_id"]).where("sample_id = 'A'").select(F.col("apex_time_min").alias("reference_apex"))
    return A.match_reference(peaks, ref, 3.0).select("sample_id", "apex_time_min", "reference_delta", r6("match_score"))


@query(
    f""", {CHROM_SQL}, x AS (SELECT a.rt, b.sample_id, b.v, b.i, abs(b.rt - a.rt) AS d, b.rt AS r FROM (VALUES (12.0), (25.0), (41.0)) a(rt) JOIN y b ON true)
 SELECT sample_id, CAST(rt AS DOUBLE) AS wanted_rt, r AS rt, v AS bpi FROM x QUALIFY row_number() OVER (PARTITION BY sample_id, rt ORDER BY d, r) = 1"""
)
def nearest_scan(spark, sf_dir):
    wanted = spark.createDataFrame([(12.0,), (25.0,), (41.0,)], "wanted_rt double")
    return P.nearest(scans(spark, sf_dir), wanted, F.col("rt"), ["sample_id"], ["rt"]).select("sample_id", "wanted_rt", "rt", "bpi")


def _tic_peaks(spark, sf_dir):
    return K.tic_peaks(written(curves(spark, sf_dir), "curves"), ["sample_id"])


@query()
def tic_peaks(spark, sf_dir):
    """Greedy apex selection and valley collapse."""
    return rounded(_tic_peaks(spark, sf_dir), **SHAPE)


@query()
def refine_boundaries(spark, sf_dir):
    return rounded(K.refine_boundaries(_tic_peaks(spark, sf_dir), ["sample_id"]), **SHAPE)


@query()
def peak_status(spark, sf_dir):
    return K.with_status(K.refine_boundaries(_tic_peaks(spark, sf_dir), ["sample_id"])).groupBy("sample_id", "status").count()


def candidate_peaks(spark, sf_dir, shifts=None):
    """Consensus and sample peaks merged, with status; peak_id in RT order."""
    c = written(curves(spark, sf_dir), "curves")
    if shifts is not None:
        c = c.join(shifts, "sample_id").withColumn("rt", F.col("rt") + F.col("rt_shift")).select("sample_id", "rt", "value")
    one = K.refine_boundaries(K.tic_peaks(S.consensus(c).withColumn("_g", F.lit(0)), ["_g"]), ["_g"])
    own = K.with_status(K.refine_boundaries(K.tic_peaks(c, ["sample_id"]), ["sample_id"])).where("status <> 'noise_peak'")
    merged = K.with_status(K.merge_candidates(one, own))
    return merged.withColumn("peak_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rt_apex"))), c


@query()
def merge_peak_candidates(spark, sf_dir):
    """A mutable greedy merge."""
    return rounded(candidate_peaks(spark, sf_dir)[0].withColumn("supporting_samples", F.array_join("supporting_samples", "|")), **SHAPE)


@query()
def landmarks(spark, sf_dir):
    """Greedy one-to-one matching."""
    return rounded(A.landmarks(chrom(spark, sf_dir), "A"), reference_area=3, sample_area=3)


@query()
def robust_shift(spark, sf_dir):
    return rounded(A.robust_shifts(A.landmarks(chrom(spark, sf_dir), "A")), rt_shift=6)


def _alignment(spark, sf_dir):
    c = written(curves(spark, sf_dir, "bpi"), "curves")
    peaks = pinned(K.chromatogram_peaks(c, ["sample_id"]))
    return A.alignment(c, peaks, K.main_peaks(c, peaks, ["sample_id"]), "A")


@query()
def rt_alignment(spark, sf_dir):
    return rounded(_alignment(spark, sf_dir), rt_shift=6)


@query(f", {CURVE} SELECT sample_id, 12.0::DOUBLE - rt AS rt_shift, rt AS apex_rt FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY abs(rt - 12), rt) = 1")
def feature_peak_alignment(spark, sf_dir):
    return A.feature_peak_alignment(scans(spark, sf_dir), 12.0)


#: Three fixed peaks, where the adapter puts its maxima.
PEAKS = [(1, 11.0, 12.0, 13.0, 2.0), (2, 23.5, 25.0, 26.5, 3.0), (3, 40.0, 41.0, 42.0, 2.0)]
PEAKS_SQL = "pk AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {w}::DOUBLE)" for i, a, b, c, w in PEAKS) + ") v(peak_id, rt_start, rt_apex, rt_end, width))"


def fixed_peaks(spark):
    return spark.createDataFrame(PEAKS, "peak_id int, rt_start double, rt_apex double, rt_end double, width double")


LOCAL_SQL = f"""{CURVE}, {PEAKS_SQL},
 lw AS (SELECT peak_id, sample_id, min_by(rt, struct_pack(h := -tic, r := rt)) AS apex FROM c JOIN pk ON rt BETWEEN rt_start - 0.08 AND rt_end + 0.08 GROUP BY ALL),
 lf AS (SELECT peak_id, s.sample_id, coalesce(apex, rt_apex) AS apex, least(0.5, greatest(0.1, 0.2 * width)) AS max_shift FROM pk CROSS JOIN (SELECT DISTINCT sample_id FROM c) s LEFT JOIN lw USING (peak_id, sample_id)),
 lg AS (SELECT *, median(apex) OVER (PARTITION BY peak_id) AS reference_apex FROM lf),
 la AS (SELECT peak_id, sample_id, apex, reference_apex, CASE WHEN abs(reference_apex - apex) > max_shift THEN 0 ELSE reference_apex - apex END AS local_shift, abs(reference_apex - apex) > max_shift AS capped, max_shift FROM lg)"""


def _local(spark, sf_dir):
    return A.local_alignment(written(curves(spark, sf_dir), "curves"), fixed_peaks(spark))


@query(f", {LOCAL_SQL} SELECT peak_id, sample_id, apex, reference_apex, round(local_shift, 6) AS local_shift, capped, round(max_shift, 6) AS max_shift FROM la")
def local_alignment(spark, sf_dir):
    return _local(spark, sf_dir).select("peak_id", "sample_id", "apex", "reference_apex", r6("local_shift"), "capped", r6("max_shift"))


#: Rows of each peak's window after its local shift.
SHIFTED_SQL = f"{LOCAL_SQL}, wc AS (SELECT peak_id, sample_id, scan_id, rt + local_shift AS rt, tic AS v FROM c JOIN la USING (sample_id) JOIN pk USING (peak_id) WHERE rt + local_shift BETWEEN rt_start - 0.08 AND rt_end + 0.08)"


def _shifts(spark, sf_dir):
    return pinned(_local(spark, sf_dir)).select("peak_id", "sample_id", F.col("local_shift").alias("shift"))


@query(
    f""", {SHIFTED_SQL}, st AS (SELECT *, lag(rt) OVER w AS r0, lag(v) OVER w AS v0 FROM wc WINDOW w AS (PARTITION BY peak_id, sample_id ORDER BY rt)),
 ar AS (SELECT peak_id, sample_id, coalesce(sum((v0 + v) / 2 * (rt - r0)), 0) AS area FROM st GROUP BY ALL),
 al AS (SELECT peak_id, s.sample_id, coalesce(area, 0) AS area FROM pk CROSS JOIN (SELECT DISTINCT sample_id FROM c) s LEFT JOIN ar USING (peak_id, sample_id)),
 mx AS (SELECT *, max(area) OVER (PARTITION BY peak_id) AS m FROM al),
 g AS (SELECT peak_id, count(*) FILTER (area >= m * 0.02 AND area > 0) AS k, count(*) AS n, any_value(m) AS m, coalesce(stddev_pop(area) FILTER (area > 0) / avg(area) FILTER (area > 0), 0) AS cv,
       coalesce((max(area) FILTER (area > 0) + 1e-12) / (min(area) FILTER (area > 0) + 1e-12), 1) AS fold FROM mx GROUP BY peak_id),
 d AS (SELECT *, CASE WHEN k < n AND m > 0 THEN greatest(1 - 1 / (1 + cv), 0.5) ELSE 1 - 1 / (1 + cv) END AS diff FROM g)
 SELECT peak_id, k AS tic_presence_count, round(cv, 6) AS tic_area_cv, round(fold, 6) AS tic_area_fold, round(diff, 6) AS tic_difference_score, round(ln(1 + m) * (1 + 1.5 * diff), 6) AS tic_selection_score FROM d"""
)
def peak_window_areas(spark, sf_dir):
    x = C.selection_scores(curves(spark, sf_dir), fixed_peaks(spark), _shifts(spark, sf_dir))
    return x.select("peak_id", "tic_presence_count", *[r6(c) for c in ("tic_area_cv", "tic_area_fold", "tic_difference_score", "tic_selection_score")])


RESAMPLED_SQL = f"""{SHIFTED_SQL}, e AS (SELECT peak_id, sample_id, min(rt) AS lo, max(rt) AS hi FROM wc GROUP BY ALL),
 g AS (SELECT e.*, k.point, least(hi, lo + (hi - lo) * k.point / 99) AS x FROM e CROSS JOIN range(0, 100) k(point)),
 nb AS (SELECT *, lead(rt) OVER w AS r1, lead(v) OVER w AS v1 FROM wc WINDOW w AS (PARTITION BY peak_id, sample_id ORDER BY rt)),
 rs AS (SELECT g.peak_id, g.sample_id, g.point, arg_min(b.v * (1 - (x - b.rt) / (b.r1 - b.rt)) + b.v1 * (x - b.rt) / (b.r1 - b.rt), b.rt) AS v FROM g JOIN nb b ON b.peak_id = g.peak_id AND b.sample_id = g.sample_id AND b.rt <= x AND x <= b.r1 GROUP BY ALL)"""


@query(f", {RESAMPLED_SQL} SELECT peak_id, sample_id, CAST(point AS INT) AS point, round(v, 3) AS value FROM rs")
def resample_curves(spark, sf_dir):
    x = C.shifted(curves(spark, sf_dir), fixed_peaks(spark), _shifts(spark, sf_dir), 0.08)
    return S.resample(x.select("peak_id", "sample_id", "rt", "value"), 100, ["peak_id", "sample_id"]).select("peak_id", "sample_id", "point", F.round("value", 3).alias("value"))


@query()
def chrom_similarity(spark, sf_dir):
    local = pinned(_local(spark, sf_dir))
    shifts = local.select("peak_id", "sample_id", F.col("local_shift").alias("shift"))
    x = C.chromatogram_scores(written(curves(spark, sf_dir), "curves"), fixed_peaks(spark), local, shifts)
    return x.select("peak_id", *[r6(c) for c in ("shape_score", "area_score", "apex_score", "width_score", "chromatogram_score")])


# --- points ----------------------------------------------------------------------------------------------------------
NOMINAL = "CAST(round(mz / 10) AS INT)"


@query(
    "SELECT sample_id, round(sum(mz * intensity) / sum(intensity), 6) AS cluster_mz, sum(intensity) AS total_intensity, max(intensity) AS max_intensity, count(DISTINCT scan_id) AS scan_count,"
    " CAST(row_number() OVER (PARTITION BY sample_id ORDER BY sum(intensity) DESC, min(mz)) AS INT) AS candidate_rank"
    f" FROM p WHERE rt BETWEEN 5 AND 50 AND mz BETWEEN 200 AND 2000 AND intensity >= 100 GROUP BY sample_id, {NOMINAL} HAVING count(DISTINCT scan_id) >= 3 QUALIFY candidate_rank <= 50"
)
def candidate_mz(spark, sf_dir):
    """Clusters of the adapter are its nominal m/z, which the SQL groups by: another formulation of the same answer."""
    x = M.candidate_mz(points(spark, sf_dir), ["sample_id"], 5.0, 50.0, least=100.0)
    return x.select("sample_id", r6("cluster_mz"), "total_intensity", "max_intensity", "scan_count", "candidate_rank")


TARGETS = [float(200 + 10 * k) for k in range(180)]


def targets(spark, ppm=20.0):
    return spark.createDataFrame([(t, t * ppm / 1e6) for t in TARGETS], "target_mz double, tolerance double")


XIC_SQL = f"""{CURVE}, t AS (SELECT 200.0::DOUBLE + 10 * k AS target_mz FROM range(0, 180) x(k)),
 h AS (SELECT scan_id, target_mz, sum(intensity) AS s, max(intensity) AS m FROM p JOIN t ON abs(mz - target_mz) <= target_mz * 20 / 1000000 GROUP BY ALL),
 x AS (SELECT sample_id, c.scan_id, rt, t.target_mz, coalesce(s, 0) AS s, coalesce(m, 0) AS m FROM c CROSS JOIN t LEFT JOIN h ON h.scan_id = c.scan_id AND h.target_mz = t.target_mz)"""


@query(f", {XIC_SQL} SELECT sample_id, scan_id, rt, target_mz, s AS intensity FROM x")
def xic_sum(spark, sf_dir):
    return P.xic(points(spark, sf_dir), scans(spark, sf_dir), targets(spark), 0.05).select("sample_id", "scan_id", "rt", "target_mz", "intensity")


@query(f", {XIC_SQL} SELECT sample_id, scan_id, rt, target_mz, m AS intensity FROM x")
def xic_max(spark, sf_dir):
    return P.xic(points(spark, sf_dir), scans(spark, sf_dir), targets(spark), 0.05, "max").select("sample_id", "scan_id", "rt", "target_mz", "intensity")


@query(f", {XIC_SQL}, k AS (SELECT sample_id, sum(tic) AS tic_sum FROM c GROUP BY ALL) SELECT sample_id, target_mz, sum(s) AS xic_sum, max(s) AS max_intensity, round(sum(s) / any_value(tic_sum), 9) AS tic_ratio FROM x JOIN k USING (sample_id) GROUP BY ALL")
def xic_tic_ratio(spark, sf_dir):
    s = scans(spark, sf_dir)
    x = P.tic_ratio(P.xic(points(spark, sf_dir), s, targets(spark), 0.05), s)
    return x.select("sample_id", "target_mz", "xic_sum", "max_intensity", F.round("tic_ratio", 9).alias("tic_ratio"))


def _xic_features(spark, sf_dir):
    x = P.xic(points(spark, sf_dir), scans(spark, sf_dir), targets(spark), 0.05)
    return K.xic_peaks(x.withColumnRenamed("intensity", "value"), ["sample_id", "target_mz"], least_height=100.0, most_width=10.0)


@query()
def xic_peaks(spark, sf_dir):
    """Strongest first with overlap suppression."""
    return rounded(_xic_features(spark, sf_dir), area=3, signal_to_noise=5)


def _matched(spark, sf_dir):
    best = _xic_features(spark, sf_dir).where("area_rank = 1").select("sample_id", F.col("target_mz").alias("mz"), F.col("rt_apex").alias("rt"), "area", "height")
    return M.match_features(best, rt_tolerance=0.75)


@query()
def match_features(spark, sf_dir):
    """Greedy groups."""
    return rounded(_matched(spark, sf_dir), area=3)


def _groups(spark, sf_dir):
    roles = spark.createDataFrame([("A", "reference"), ("N", "target"), ("R", "target")], "sample_id string, role string")
    return M.feature_groups(_matched(spark, sf_dir), roles)


GROUP = {"representative_mz": 6, "representative_rt": 6, "cv": 6, "max_fold_change": 5, "confidence_score": 6}


@query()
def feature_groups(spark, sf_dir):
    return rounded(_groups(spark, sf_dir).drop("sample_presence", "area_by_sample"), **GROUP)


@query()
def feature_matrix_pivot(spark, sf_dir):
    return rounded(M.feature_matrix(_groups(spark, sf_dir), ["A", "N", "R"]), area_A=3, area_N=3, area_R=3, **GROUP)


def feature_pipeline_of(points, scans, roles, rt_start, rt_end, least, top=50, ppm=20.0, rt_tolerance=0.2, **peak):
    """Feature groups of points from their own candidates: each sample's strongest clusters of m/z, their XICs over the whole run, the
    best peak of each, matching across samples. roles: (sample_id, role)."""
    found = written(M.candidate_mz(points, ["sample_id"], rt_start, rt_end, least=least, ppm=ppm, top=top).select("sample_id", "cluster_mz"), "candidates")
    own = found.select("sample_id", F.col("cluster_mz").alias("target_mz"), (F.col("cluster_mz") * ppm / 1e6).alias("tolerance"))
    xics = P.xic(points, scans, own, ppm=ppm).withColumnRenamed("intensity", "value")
    best = K.xic_peaks(xics, ["sample_id", "target_mz"], **peak).where("area_rank = 1")
    best = best.select("sample_id", F.col("target_mz").alias("mz"), F.col("rt_apex").alias("rt"), "area", "height")
    return M.feature_groups(M.match_features(best, ppm, rt_tolerance), roles)


@query()
def feature_pipeline(spark, sf_dir):
    """Candidates to matrix: all that candidate_mz finds, up to 200 a sample."""
    roles = spark.createDataFrame([("A", "reference"), ("N", "target"), ("R", "target")], "sample_id string, role string")
    g = feature_pipeline_of(points(spark, sf_dir), scans(spark, sf_dir), roles, 5.0, 50.0, 100.0, 200, rt_tolerance=0.75, least_height=100.0, most_width=10.0)
    return rounded(M.feature_matrix(g, ["A", "N", "R"]), area_A=3, area_N=3, area_R=3, **GROUP)


@query(
    "SELECT sample_id, mz, sum(intensity) AS intensity, CAST(row_number() OVER (ORDER BY sum(intensity) DESC, sample_id, mz) AS INT) AS peak_rank FROM p WHERE rt BETWEEN 11 AND 13 AND mz BETWEEN 400 AND 900 AND intensity > 0 GROUP BY sample_id, mz QUALIFY peak_rank <= 25"
)
def top_peaks_of_view(spark, sf_dir):
    """The strongest peaks of all samples' summed spectra within a view's m/z."""
    s = P.rt_window(points(spark, sf_dir), 11.0, 13.0).groupBy("sample_id", "mz").agg(F.sum("intensity").alias("intensity"))
    return P.top_of_view(s, 400.0, 900.0, 25, ["sample_id", "mz"])


#: The line items as points of one crowded stretch of m/z, 60 mTh wide at each of three places, 2^-14 apart: whole tolerances without a gap.
CROWDED = "CAST(500.0 AS DOUBLE) + 100 * (l_suppkey % 3) + CAST((l_partkey * 7919) % 983 AS DOUBLE) / CAST(16384.0 AS DOUBLE)"


@query()
def crowded_clusters(spark, sf_dir):
    """Clusters of m/z where islands are wider than the tolerance, so that points are folded one after the other."""
    x = points(spark, sf_dir).withColumn("mz", F.expr(CROWDED)).where("intensity > 0")
    return M.clusters(x, ["sample_id"], 20.0, order=("mz", "intensity", "scan_id"), piece_rows=10_000).select("sample_id", r6("cluster_mz"), "total_intensity", "max_intensity", "scan_count")


SPECTRUM = "SELECT sample_id, CAST(floor(mz / 0.5 + 0.5) AS BIGINT) AS mz_bin, {v} AS intensity FROM p {w} GROUP BY 1, 2"


@query(SPECTRUM.format(v="sum(intensity)", w="WHERE rt BETWEEN 11 AND 13"))
def spectrum_sum(spark, sf_dir):
    return P.merged_spectrum(P.rt_window(points(spark, sf_dir), 11.0, 13.0), 0.5, ["sample_id"]).select("sample_id", "mz_bin", "intensity")


@query("SELECT sample_id, mz_bin, round(intensity / n, 6) AS intensity FROM (" + SPECTRUM.format(v="sum(intensity)", w="WHERE rt BETWEEN 11 AND 13") + ") JOIN (SELECT sample_id, count(DISTINCT scan_id) AS n FROM p WHERE rt BETWEEN 11 AND 13 GROUP BY ALL) USING (sample_id)")
def spectrum_avg(spark, sf_dir):
    return P.merged_spectrum(P.rt_window(points(spark, sf_dir), 11.0, 13.0), 0.5, ["sample_id"], True).select("sample_id", "mz_bin", r6("intensity"))


@query(f", {CURVE}, a AS (SELECT scan_id FROM c WHERE rt BETWEEN 10 AND 14 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY tic DESC, rt) = 1) SELECT sample_id, p.scan_id, mz, sum(intensity) AS intensity FROM p JOIN a USING (scan_id) GROUP BY ALL")
def spectrum_apex(spark, sf_dir):
    p = points(spark, sf_dir)
    top = P.rt_window(P.chromatogram(p), 10.0, 14.0).groupBy("sample_id").agg(F.max_by("scan_id", F.struct("tic", -F.col("rt"))).alias("scan_id"))
    return p.join(top, ["sample_id", "scan_id"]).groupBy("sample_id", "scan_id", "mz").agg(F.sum("intensity").alias("intensity"))


# --- spectra of peaks ------------------------------------------------------------------------------------------------
def _spectra(spark, sf_dir):
    p, peaks, sh = points(spark, sf_dir), fixed_peaks(spark), _shifts(spark, sf_dir)
    return C.summed_spectra(p, peaks, sh, order=KEYS), C.apex_spectra(p, P.chromatogram(p), peaks, sh, KEYS)


KEYS = ("mz", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "price")
#: Bins of the adapter are its nominal m/z again.
MATRIX_SQL = f"""{SHIFTED_SQL}, sp AS (SELECT peak_id, p.sample_id, p.scan_id, mz, intensity FROM p JOIN la USING (sample_id) JOIN pk USING (peak_id)
   WHERE intensity > 0 AND p.rt + local_shift BETWEEN rt_start - 0.08 AND rt_end + 0.08 QUALIFY row_number() OVER (PARTITION BY peak_id, p.sample_id, p.scan_id ORDER BY intensity DESC, mz) <= 200),
 bn AS (SELECT peak_id, {NOMINAL} AS k, sum(mz * intensity) / sum(intensity) AS bin_mz FROM sp GROUP BY ALL),
 bi AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY bin_mz) - 1 AS bin_index FROM bn),
 ms AS (SELECT DISTINCT sample_id FROM c),
 mt AS (SELECT b.peak_id, b.bin_index, b.bin_mz, b.k, s.sample_id, coalesce(sum(sp.intensity), 0) AS v FROM bi b CROSS JOIN ms s LEFT JOIN sp ON sp.peak_id = b.peak_id AND CAST(round(sp.mz / 10) AS INT) = b.k AND sp.sample_id = s.sample_id GROUP BY ALL),
 tt AS (SELECT peak_id, bin_index, sum(v) AS t FROM mt GROUP BY ALL),
 kp AS (SELECT peak_id, bin_index FROM (SELECT *, max(t) OVER (PARTITION BY peak_id) AS mx FROM tt) WHERE mx <= 0 OR t >= mx * 0.001 QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY t DESC, bin_index) <= 50),
 rm AS (SELECT * FROM mt JOIN kp USING (peak_id, bin_index)),
 ln AS (SELECT *, ln(1 + v / CASE WHEN sum(v) OVER w = 0 THEN 1 ELSE sum(v) OVER w END * 1000000) AS nv FROM rm WINDOW w AS (PARTITION BY peak_id, sample_id))"""


def _matrix(spark, sf_dir):
    s, _ = _spectra(spark, sf_dir)
    samples = scans(spark, sf_dir).select("sample_id").distinct()
    return C.vectors(s, pinned(C.consensus_bins(s)), samples, keys=KEYS)


@query(f", {MATRIX_SQL} SELECT peak_id, CAST(bin_index AS INT) AS bin_index, round(bin_mz, 6) AS bin_mz FROM bi")
def consensus_bins(spark, sf_dir):
    return C.consensus_bins(_spectra(spark, sf_dir)[0]).select("peak_id", "bin_index", r6("bin_mz"))


@query(f", {MATRIX_SQL} SELECT peak_id, CAST(bin_index AS INT) AS bin_index, sample_id, v AS value FROM mt")
def vectorize_nearest_bin(spark, sf_dir):
    return _matrix(spark, sf_dir).select("peak_id", "bin_index", "sample_id", "value")


@query(f", {MATRIX_SQL} SELECT peak_id, CAST(bin_index AS INT) AS bin_index, sample_id, v AS value FROM rm")
def reduce_bins(spark, sf_dir):
    return C.reduced(_matrix(spark, sf_dir)).select("peak_id", "bin_index", "sample_id", "value")


@query(
    f""", {MATRIX_SQL}, g AS (SELECT peak_id, bin_index, bin_mz, avg(nv) AS mean_intensity, coalesce(stddev_pop(nv) / avg(nv), 0) AS cv, count(*) AS s, count(*) FILTER (v > 0) AS presence_count,
   (max(nv) + 1e-12) / (coalesce(min(nv) FILTER (nv > 0), 1e-12) + 1e-12) AS fold FROM ln GROUP BY ALL HAVING count(*) FILTER (v > 0) > 0)
 SELECT peak_id, CAST(bin_index AS INT) AS bin_index, presence_count, round(mean_intensity, 6) AS mean_intensity, round(cv, 6) AS cv,
   CASE WHEN presence_count < s AND presence_count <= s / 2 THEN 'new_mz_signal' WHEN presence_count < s THEN 'missing_mz_signal' WHEN cv > 0.25 THEN 'common_but_changed' ELSE 'unstable_low_confidence' END AS difference_type,
   round(cv / (1 + cv) * ln(1 + mean_intensity) + CASE WHEN presence_count < s THEN 0.5 ELSE 0 END, 6) AS ranking_score FROM g"""
)
def mz_changes(spark, sf_dir):
    x = C.mz_changes(C.reduced(_matrix(spark, sf_dir)))
    return x.select("peak_id", "bin_index", "presence_count", r6("mean_intensity"), r6("cv"), "difference_type", r6("ranking_score"))


@query()
def changed_mz(spark, sf_dir):
    """mz_changes with greedy spacing."""
    x = C.top_changes(C.mz_changes(C.reduced(_matrix(spark, sf_dir))))
    return rounded(x, bin_mz=6, mean_intensity=5, cv=6, max_fold_change=4, ranking_score=6)


COSINES = """n{i} AS (SELECT *, median(nv) OVER (PARTITION BY peak_id, bin_index) AS md FROM {t}),
 c{i} AS (SELECT peak_id, avg(cs) AS cs FROM (SELECT peak_id, sample_id, CASE WHEN sqrt(sum(nv * nv)) * sqrt(sum(md * md)) > 0 THEN least(1, sum(nv * md) / (sqrt(sum(nv * nv)) * sqrt(sum(md * md)))) ELSE 0 END AS cs FROM n{i} GROUP BY ALL) GROUP BY ALL)"""


SPECTRUM_SQL = f"""{MATRIX_SQL}, {COSINES.format(i=1, t='ln')},
 an AS (SELECT peak_id, sample_id, arg_min(scan_id, struct_pack(d := abs(rt + local_shift - rt_apex), r := rt, s := scan_id)) AS scan_id FROM c JOIN la USING (sample_id) JOIN pk USING (peak_id) GROUP BY ALL),
 ap AS (SELECT peak_id, p.sample_id, {NOMINAL} AS k, sum(intensity) AS v FROM p JOIN an ON an.scan_id = p.scan_id WHERE intensity > 0 GROUP BY ALL),
 am AS (SELECT r.peak_id, r.bin_index, r.sample_id, coalesce(ap.v, 0) AS v FROM rm r LEFT JOIN ap ON ap.peak_id = r.peak_id AND ap.k = r.k AND ap.sample_id = r.sample_id),
 al AS (SELECT *, ln(1 + v / CASE WHEN sum(v) OVER w = 0 THEN 1 ELSE sum(v) OVER w END * 1000000) AS nv FROM am WINDOW w AS (PARTITION BY peak_id, sample_id)), {COSINES.format(i=2, t='al')},
 tp AS (SELECT peak_id, max(n) / count(DISTINCT bin_index) AS o FROM (SELECT *, least(20, count(DISTINCT bin_index) OVER (PARTITION BY peak_id)) AS n FROM rm QUALIFY row_number() OVER (PARTITION BY peak_id, sample_id ORDER BY v DESC, bin_index) <= n) GROUP BY ALL),
 bb AS (SELECT peak_id, bin_index, count(*) FILTER (v > 0) AS n, count(*) AS s, stddev_pop(v) / avg(v) AS cv FROM rm GROUP BY ALL HAVING n > 0),
 b2 AS (SELECT peak_id, coalesce(median(cv) FILTER (n = s), 0) AS cv, avg(CASE WHEN n < s THEN 1.0 ELSE 0.0 END) AS miss FROM bb GROUP BY ALL),
 ss AS (SELECT peak_id, c1.cs AS cs1, o, 1 / (1 + cv) AS ra, 1 - miss AS pa, c2.cs AS cs2, 0.45 * c1.cs + 0.2 * o + 0.15 / (1 + cv) + 0.1 * (1 - miss) + 0.1 * c2.cs AS spectrum_score FROM c1 JOIN c2 USING (peak_id) JOIN tp USING (peak_id) JOIN b2 USING (peak_id))"""


@query(
    f""", {SPECTRUM_SQL} SELECT peak_id, round(cs1, 6) AS cosine_score, round(o, 6) AS top_mz_overlap_score, round(ra, 6) AS relative_abundance_score, round(pa, 6) AS presence_absence_score,
      round(cs2, 6) AS apex_spectrum_score, round(spectrum_score, 6) AS spectrum_score FROM ss"""
)
def spectrum_similarity(spark, sf_dir):
    s, a = _spectra(spark, sf_dir)
    samples = scans(spark, sf_dir).select("sample_id").distinct()
    bins = pinned(C.consensus_bins(s))
    m = pinned(C.reduced(C.vectors(s, bins, samples, keys=KEYS)))
    kept = m.select("peak_id", "bin_index", "bin_mz").distinct()
    x = C.spectrum_scores(m, C.vectors(a, kept, samples, keys=KEYS))
    return x.select("peak_id", *[r6(c) for c in ("cosine_score", "top_mz_overlap_score", "relative_abundance_score", "presence_absence_score", "apex_spectrum_score", "spectrum_score")])


def _features(spark, sf_dir):
    p, peaks, sh = points(spark, sf_dir), fixed_peaks(spark), _shifts(spark, sf_dir)
    top = C.top_changes(C.mz_changes(C.reduced(_matrix(spark, sf_dir)))).select("peak_id", "candidate_rank", F.col("bin_mz").alias("target_mz"))
    return pinned(C.candidate_features(p, P.chromatogram(p), pinned(top), peaks, sh)), peaks


@query()
def peak_features(spark, sf_dir):
    """signal_to_noise is cut at 10^9: over a noise of nothing it has no digits to compare."""
    x = _features(spark, sf_dir)[0].withColumn("signal_to_noise", F.least(F.lit(1e9), F.col("signal_to_noise")))
    return rounded(x, target_mz=6, mz=6, rt_start=6, rt_apex=6, rt_end=6, area=3, signal_to_noise=4)


def _by_sample(groups):
    """Maps by sample as columns of the adapter's samples."""
    maps = {"area": "area_by_sample", "match": "match_score_by_sample"}
    return groups.select(*[c for c in groups.columns if c not in maps.values()], *[F.try_element_at(m, F.lit(x)).alias(f"{c}_{x}") for c, m in maps.items() for x in "ANR"])


def _rounded_groups(groups):
    return rounded(_by_sample(groups), **greedy_sql.PFG)


@query()
def peak_feature_groups(spark, sf_dir):
    return _rounded_groups(C.peak_feature_groups(*_features(spark, sf_dir)))


@query()
def global_features(spark, sf_dir):
    x = C.global_features(C.peak_feature_groups(*_features(spark, sf_dir)))
    for c in ("merged_feature_group_ids", "merged_peak_ids"):
        x = x.withColumn(c, F.array_join(c, "|"))
    return rounded(x, representative_mz=6, representative_rt=6, difference_score=6, ranking_score=6, max_area=3, max_fold_change=4)


@query()
def peak_first_scores(spark, sf_dir):
    """The whole peak-first comparison: alignment, merged candidates, selection, scores and status."""
    from scanlake.plans.peak_first import compare

    x = compare(spark, sf_dir)
    return rounded(x, **{c: 6 for c, kind in x.dtypes if kind == "double"})


# --- the grid --------------------------------------------------------------------------------------------------------
GRID = G.Grid(5.0, 50.0, 195.0, 1995.0, 180, 160)


def grid_sql(g, name="gr"):
    return (
        f"{name} AS (SELECT sample_id, CAST(trunc((mz - {g.mz_min}::DOUBLE) / {g.mz_step!r}::DOUBLE) AS INT) AS mz_index, CAST(trunc((rt - {g.rt_min}::DOUBLE) / {g.rt_step!r}::DOUBLE) AS INT) AS rt_index, sum(intensity) AS raw"
        f" FROM p WHERE trunc((mz - {g.mz_min}::DOUBLE) / {g.mz_step!r}::DOUBLE) BETWEEN 0 AND {g.mz_bins - 1} AND trunc((rt - {g.rt_min}::DOUBLE) / {g.rt_step!r}::DOUBLE) BETWEEN 0 AND {g.rt_bins - 1} GROUP BY ALL)"
    )


FACTORS_SQL = "fa AS (SELECT sample_id, coalesce(sum(raw) FILTER (raw > 0), 1) AS tic, coalesce(max(raw), 1) AS max, coalesce(median(raw) FILTER (raw > 0), 1) AS median, coalesce(greatest(max(raw) * 0.01, quantile_cont(raw, 0.05) FILTER (raw > 0)), 0) AS floor FROM gr GROUP BY ALL)"


@query(f", {grid_sql(GRID)} SELECT * FROM gr")
def intensity_grid(spark, sf_dir):
    return G.cells(points(spark, sf_dir), GRID)


@query(f", {grid_sql(GRID)}, {FACTORS_SQL} SELECT sample_id, tic, max, round(median, 4) AS median FROM fa")
def grid_norm_factors(spark, sf_dir):
    return G.factors(G.cells(points(spark, sf_dir), GRID)).select("sample_id", "tic", "max", F.round("median", 4).alias("median"))


@query(f", {grid_sql(GRID)}, {FACTORS_SQL} SELECT sample_id, round(floor, 4) AS floor FROM fa")
def signal_floor(spark, sf_dir):
    return G.factors(G.cells(points(spark, sf_dir), GRID)).select("sample_id", F.round("floor", 4).alias("floor"))


def near_sql(g):
    """Neighbourhood maxima by looking at every neighbour that has a value."""
    return f"""{grid_sql(g)}, {FACTORS_SQL},
 lm AS (SELECT sample_id, mz_index + a.d AS mz_index, rt_index + b.d AS rt_index, max(raw) AS near FROM gr CROSS JOIN range(-{g.mz_radius}, {g.mz_radius + 1}) a(d) CROSS JOIN range(-{g.rt_radius}, {g.rt_radius + 1}) b(d)
        WHERE mz_index + a.d BETWEEN 0 AND {g.mz_bins - 1} AND rt_index + b.d BETWEEN 0 AND {g.rt_bins - 1} GROUP BY ALL),
 nr AS (SELECT sample_id, mz_index, rt_index, CASE WHEN near < floor THEN 0 ELSE near END AS raw, CASE WHEN near < floor OR near <= 0 THEN 0 ELSE ln(1 + near / tic * 1000000) END AS nv FROM lm JOIN fa USING (sample_id))"""


@query(f", {near_sql(GRID)} SELECT sample_id, CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, near FROM lm WHERE near > 0")
def grid_local_max(spark, sf_dir):
    return G.local_max(G.cells(points(spark, sf_dir), GRID), GRID)


def scores_sql(g, samples=3, where=""):
    return f"""{near_sql(g)}, cs AS (SELECT mz_index, rt_index, max(raw) AS max_intensity, sum(nv) / {samples} AS mean, sqrt(greatest(sum(nv * nv) / {samples} - (sum(nv) / {samples}) ** 2, 0)) AS sd, count(*) FILTER (raw > 0) AS present,
   CASE WHEN count(*) FILTER (nv > 0) >= 2 THEN (max(nv) + 1e-12) / (min(nv) FILTER (nv > 0) + 1e-12) END AS fold FROM nr {where} GROUP BY ALL HAVING max(raw) > 0),
 sc AS (SELECT *, CASE WHEN mean > 0 THEN 1 / (1 + sd / mean) ELSE 0 END AS score FROM cs)"""


def _near(spark, sf_dir, g=GRID):
    c = G.cells(points(spark, sf_dir), g)
    return G.neighbourhood(c, g, points(spark, sf_dir).select("sample_id").distinct())


@query(f", {scores_sql(GRID)} SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, max_intensity, round(score, 5) AS score, CAST(present AS INT) AS present FROM sc")
def cohort_scores(spark, sf_dir):
    return G.cohort_scores(_near(spark, sf_dir)).select("mz_index", "rt_index", "max_intensity", F.round("score", 5).alias("score"), "present")


@query(f", {scores_sql(GRID, 2, where='WHERE sample_id <> ' + chr(39) + 'N' + chr(39))} SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, max_intensity, round(score, 5) AS score FROM sc")
def subset_scores(spark, sf_dir):
    """The cohort map of two of the samples, floors and factors as before."""
    return G.cohort_scores(_near(spark, sf_dir).where("sample_id <> 'N'")).select("mz_index", "rt_index", "max_intensity", F.round("score", 5).alias("score"))


@query(
    f""", {near_sql(GRID)}, pr AS (SELECT mz_index, rt_index, coalesce(max(raw) FILTER (sample_id = 'A'), 0) AS r0, coalesce(max(raw) FILTER (sample_id = 'R'), 0) AS r1, coalesce(max(nv) FILTER (sample_id = 'A'), 0) AS n0, coalesce(max(nv) FILTER (sample_id = 'R'), 0) AS n1 FROM nr GROUP BY ALL),
 ps AS (SELECT *, 1 - abs(n0 - n1) / (n0 + n1 + 1e-9) AS score, (n1 + 1e-12) / (n0 + 1e-12) AS fold FROM pr WHERE r0 > 0 OR r1 > 0)
 SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, r0 AS reference_raw, r1 AS sample_raw, round(score, 6) AS score,
   CASE WHEN r0 <= 0 AND r1 > 0 THEN 'new_signal' WHEN r0 > 0 AND r1 <= 0 THEN 'missing_signal' WHEN score > 0.75 THEN 'uncertain' WHEN fold >= 1.5 THEN 'intensity_increased' WHEN fold <= 1 / 1.5 THEN 'intensity_decreased' ELSE 'uncertain' END AS difference_type,
   round(CASE WHEN n1 >= n0 THEN 1 - score ELSE score - 1 END, 6) AS directional FROM ps"""
)
def pair_scores(spark, sf_dir):
    x = G.pair_scores(_near(spark, sf_dir), "A", "R")
    return x.select("mz_index", "rt_index", "reference_raw", "sample_raw", r6("score"), "difference_type", r6(directional_difference(F.col("score"), F.col("sample_norm"), F.col("reference_norm")), "directional"))


@query(
    f""", {scores_sql(GRID)}, rg AS (SELECT * FROM sc WHERE score < 0.75), qq AS (SELECT coalesce(quantile_cont(mean, 0.9) FILTER (mean > 0), 0) AS q FROM rg)
 SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, round({GRID.rt_min} + (rt_index + 0.5) * {GRID.rt_step!r}, 6) AS rt, round({GRID.mz_min} + (mz_index + 0.5) * {GRID.mz_step!r}, 6) AS mz,
   CASE WHEN present > 0 AND present < 3 THEN 'new_signal' WHEN fold >= 1.5 THEN 'intensity_increased' ELSE 'uncertain' END AS difference_type,
   CASE WHEN present < 3 THEN 'presence_absence' ELSE 'high_confidence' END AS signal_status, round(CASE WHEN q > 0 AND mean > 0 THEN least(1, sqrt(mean / q)) ELSE 0 END * (1 - score), 5) AS weighted_difference_score FROM rg, qq"""
)
def difference_regions(spark, sf_dir):
    x = G.regions(G.cohort_scores(_near(spark, sf_dir)), GRID)
    return x.select("mz_index", "rt_index", r6("rt"), r6("mz"), "difference_type", "signal_status", F.round("weighted_difference_score", 5).alias("weighted_difference_score"))


REGION = ("mz_index", "rt_index", "rt", "mz", "difference_type", "weighted_difference_score")
REGION_DIGITS = {"rt": 6, "mz": 6, "score": 5, "weighted_difference_score": 5}


def _ordered_regions(near):
    return rounded(G.regions(G.cohort_scores(near), GRID), weighted_difference_score=9, difference_score=9)


@query()
def distinct_regions(spark, sf_dir):
    """Greedy two-dimensional suppression; scores are compared to nine digits, so that equal cells keep the order of their indexes."""
    return rounded(G.distinct_regions(_ordered_regions(_near(spark, sf_dir)), GRID).select(*REGION, "max_intensity", "score", "signal_status", "region_rank"), **REGION_DIGITS)


ZOOM = G.Grid.zoom(10.0, 14.0, 400.0, 600.0)


@query(f", {scores_sql(ZOOM)} SELECT CAST(mz_index AS INT) AS mz_index, CAST(rt_index AS INT) AS rt_index, max_intensity, round(score, 5) AS score, CAST(present AS INT) AS present FROM sc")
def zoom_regrid(spark, sf_dir):
    return G.cohort_scores(_near(spark, sf_dir, ZOOM)).select("mz_index", "rt_index", "max_intensity", F.round("score", 5).alias("score"), "present")


@query(f", {grid_sql(GRID)} SELECT * FROM gr WHERE rt_index BETWEEN 28 AND 36 AND mz_index BETWEEN 18 AND 36")
def heatmap_slice(spark, sf_dir):
    return G.window(G.cells(points(spark, sf_dir), GRID), GRID, 12.0, 14.0, 400.0, 600.0)


@query(f", {CURVE} SELECT greatest(10.0, min(rt)) AS rt_min, least(40.0, max(rt)) AS rt_max FROM c")
def effective_rt_range(spark, sf_dir):
    return G.effective_rt_range(scans(spark, sf_dir), 10.0, 40.0)


@query(f", {grid_sql(GRID)}, x AS (SELECT * FROM gr WHERE rt_index = 28 AND mz_index = 44) SELECT sample_id, raw, round(CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END * 100, 6) AS relative_percent FROM x")
def cell_lookup(spark, sf_dir):
    return G.cell_intensities(G.cells(points(spark, sf_dir), GRID), GRID, 12.1, 700.0).select("sample_id", "raw", r6("relative_percent"))


@query()
def auto_region_matrix(spark, sf_dir):
    from scanlake.plans.matrices import auto_regions, region_matrix

    near = _near(spark, sf_dir)
    x = region_matrix(auto_regions(G.distinct_regions(_ordered_regions(near), GRID), "cohort:all_samples:tic_log1p"), near, ["A", "N", "R"])
    return rounded(x, **REGION_DIGITS, **{f"{s}_normalized": 6 for s in "ANR"})


# --- other tables ----------------------------------------------------------------------------------------------------
QUERIES["embedding_cosine"] = lambda spark, sf_dir: _embedding_cosine(spark, sf_dir)
ORACLE["embedding_cosine"] = """WITH m AS (SELECT label, i, median(CAST(x AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
 mm AS (SELECT label, list(v ORDER BY i) AS m FROM m GROUP BY ALL)
 SELECT vec_id, label, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), m))), 5) AS cosine FROM embeddings JOIN mm USING (label)"""


def _embedding_cosine(spark, sf_dir):
    """Each vector's cosine to the median vector of its label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.median(F.col("x").cast("double")).alias("v"))
    m = m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))
    x = e.join(m, "label").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return x.select("vec_id", "label", F.round(cosine(F.col("v"), F.col("m.v")), 5).alias("cosine"))


QUERIES["event_cohort"] = lambda spark, sf_dir: _event_cohort(spark, sf_dir)
ORACLE["event_cohort"] = """WITH b AS (SELECT event_type AS sample_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, sum(value) AS v FROM events GROUP BY ALL),
 s AS (SELECT count(DISTINCT event_type) AS n FROM events),
 g AS (SELECT hour, sum(v) / any_value(n) AS mean, sqrt(greatest(sum(v * v) / any_value(n) - (sum(v) / any_value(n)) ** 2, 0)) AS sd FROM b, s GROUP BY hour)
 SELECT hour, round(mean, 4) AS mean, round(CASE WHEN mean > 0 THEN 1 / (1 + sd / mean) ELSE 0 END, 4) AS score FROM g"""


def _event_cohort(spark, sf_dir):
    """The cohort score over five samples, the event types, by hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("sample_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour"), "value")
    n = e.agg(F.countDistinct("sample_id").alias("n"))
    b = e.groupBy("hour", "sample_id").agg(F.sum("value").alias("v")).groupBy("hour").agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    mean = F.col("v") / F.col("n")  # a type without events in an hour counts as 0
    x = b.crossJoin(F.broadcast(n)).select("hour", mean.alias("mean"), F.sqrt(F.greatest(F.col("vv") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
    return x.select("hour", F.round("mean", 4).alias("mean"), F.round(F.when(F.col("mean") > 0, 1 / (1 + F.col("sd") / F.col("mean"))).otherwise(0.0), 4).alias("score"))


@query(f", {LOCAL_SQL} SELECT peak_id, sample_id, round(rt_start - 0.08, 6) AS aligned_start, round(rt_end + 0.08, 6) AS aligned_end, round(rt_start - 0.08 - local_shift, 6) AS corrected_start, round(rt_end + 0.08 - local_shift, 6) AS corrected_end FROM la JOIN pk USING (peak_id)")
def cut_bounds(spark, sf_dir):
    x = A.cut_bounds(fixed_peaks(spark), _local(spark, sf_dir))
    return x.select("peak_id", "sample_id", *[r6(c) for c in ("aligned_start", "aligned_end", "corrected_start", "corrected_end")])


XIC_DEMAND_SQL = f"""{LOCAL_SQL}, hx AS (SELECT scan_id, sum(intensity) AS v FROM p WHERE abs(mz - 700) <= 0.5 GROUP BY ALL),
 xd AS (SELECT peak_id, sample_id, c.scan_id, c.rt AS raw_rt, CASE WHEN c.rt + local_shift = 0 THEN c.rt ELSE c.rt + local_shift END AS rt, coalesce(v, 0) AS intensity, rt_start, rt_end
        FROM c JOIN la USING (sample_id) JOIN pk USING (peak_id) LEFT JOIN hx USING (scan_id))"""


def _on_demand(spark, sf_dir, full=False):
    p = points(spark, sf_dir)
    return C.xic_on_demand(p, P.chromatogram(p), fixed_peaks(spark), _shifts(spark, sf_dir), 700.0, full)


@query(f", {XIC_DEMAND_SQL} SELECT peak_id, sample_id, scan_id, raw_rt, round(rt, 6) AS rt, intensity, rt BETWEEN rt_start - 0.08 AND rt_end + 0.08 AS in_peak FROM xd WHERE rt BETWEEN rt_start - 3 AND rt_end + 3")
def xic_on_demand(spark, sf_dir):
    return _on_demand(spark, sf_dir).withColumn("rt", F.round("rt", 6))


@query(
    f", {XIC_DEMAND_SQL}, sx AS (SELECT *, lag(rt) OVER w AS r0, lag(intensity) OVER w AS v0 FROM xd WHERE rt BETWEEN rt_start - 0.08 AND rt_end + 0.08 WINDOW w AS (PARTITION BY peak_id, sample_id ORDER BY rt))"
    " SELECT peak_id, sample_id, round(coalesce(sum((v0 + intensity) / 2 * (rt - r0)), 0), 4) AS area, max(intensity) AS height FROM sx GROUP BY ALL"
)
def xic_areas(spark, sf_dir):
    return C.xic_areas(_on_demand(spark, sf_dir, True)).withColumn("area", F.round("area", 4))


@query()
def nearest_group(spark, sf_dir):
    """The feature group nearest to m/z 700."""
    return _rounded_groups(C.nearest_group(C.peak_feature_groups(*_features(spark, sf_dir)), 700.0, limited=False))


QUERIES["saved_feature_upsert"] = lambda spark, sf_dir: _saved_feature_upsert(spark, sf_dir)
ORACLE["saved_feature_upsert"] = """SELECT n.n_name AS feature_id, concat('{"mz":', n.n_nationkey, '}') AS feature_json, CASE WHEN n.n_nationkey % 2 = 0 THEN '2020' ELSE '2024' END AS created_at, '2024' AS updated_at
 FROM nation n WHERE n.n_nationkey % 5 <> 0"""


def _saved_feature_upsert(spark, sf_dir):
    """Every fifth nation's feature has unreadable JSON; the even ones were saved before."""
    from scanlake.plans.matrices import upsert_features

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    old = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("feature_id"), F.lit("2020").alias("created_at"))
    text = F.when(F.col("n_nationkey") % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"mz":'), F.col("n_nationkey").cast("string"), F.lit("}")))
    new = n.select(F.col("n_nationkey").alias("ord"), F.lit(None).cast("string").alias("region_id"), F.col("n_name").alias("feature_id"), text.alias("feature_json"), F.lit(None).cast("string").alias("created_at"))
    return upsert_features(old, new, F.lit("2024"))


from scanlake.plans import greedy_sql  # noqa: E402, F401  (adds to ORACLE)

from scanlake.plans import workbench  # noqa: E402, F401  (adds to QUERIES and ORACLE)
