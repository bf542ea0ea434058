"""m/z clustering and cross-sample feature matching: sequential folds, cut into islands that cannot touch each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import cv_of_positives, fold_change, group_difference, lit, ppm_window
from scanlake.operators.shared import in_pieces, islands, small_side, written


def bins_of(ppm: float | None, da: float) -> Column:
    """Number of the m/z bin of half the tolerance (so rounding does no harm): in parts per million on a logarithmic scale, else in Da."""
    if ppm is None:
        return F.floor(F.col("mz") / (da / 2)).cast("long")
    return F.floor(F.log(F.greatest(F.col("mz"), lit(1e-6))) / (ppm * 0.5e-6)).cast("long")


def clusters(points: DataFrame, by: list[str], ppm: float | None, da: float = 0.5, order: tuple[str, ...] = ("mz", "intensity"), least: float = 0.0, piece_rows: int = 1 << 17) -> DataFrame:
    """(by.., cluster_mz, total_intensity, max_intensity, scan_count): points join the running cluster while they lie within the
    tolerance of its weighted centre (ppm, or da). Points need a positive intensity, of at least `least`.

    A weighted centre never exceeds the last m/z, so no cluster crosses a gap wider than the tolerance. An island no wider than
    the tolerance at its lower end is one cluster whatever the order, so aggregates alone give it. In wider ones a point at the m/z of
    its cluster's last is always within reach, so points of one m/z are one, whatever the rest of `order`: what is folded in pieces (see
    fold_pieces) has a row per m/z. points are read once for the bins, once more for the aggregates, and where islands are wide once for those.
    """
    points = points.where(F.col("intensity") >= least if least > 0 else F.col("intensity") > 0)
    tol = lambda x: F.greatest(ppm_window(F.col(x), ppm), lit(1e-9)) if ppm is not None else lit(da)
    bins = islands(points, by, "mz", bins_of(ppm, da), tol("_before")).withColumn("_wide", F.col("_hi") - F.col("_lo") > tol("_lo"))
    bins = written(bins.select(*by, "_bin", "island", "_wide"), "mz-bins")
    pick = lambda wide: points.withColumn("_bin", bins_of(ppm, da)).join(small_side(bins.where(F.col("_wide") == wide).drop("_wide")), [*by, "_bin"])
    # by scan, then by cluster: a distinct count beside sums of long expressions makes code that is too long to be compiled
    scan = lambda df, keys, heavy, weight, top: df.groupBy(*keys, "scan_id").agg(F.sum(heavy).alias("heavy"), F.sum(weight).alias("weight"), F.max(top).alias("top"))
    sums = [(F.sum("heavy") / F.sum("weight")).alias("cluster_mz"), F.sum("weight").alias("total_intensity"), F.max("top").alias("max_intensity"), F.count("scan_id").alias("scan_count")]
    one = scan(pick(False), [*by, "island"], F.col("mz") * F.col("intensity"), "intensity", "intensity").groupBy(*by, "island").agg(*sums).drop("island")
    if not bins.where("_wide").limit(1).count():
        return one
    near = (lambda centre: max(abs(centre) * ppm / 1e6, 1e-9)) if ppm is not None else (lambda centre: da)
    wide = pick(True).groupBy(*by, "island", "mz", "scan_id").agg(F.sum("intensity").alias("weight"), F.max("intensity").alias("top"))
    wide = written(wide, "mz-scans")
    starts = fold_pieces(wide.groupBy(*by, "island", "mz").agg(F.sum("weight").alias("weight")), by, near, piece_rows)
    parts = wide.join(small_side(written(starts, "mz-starts")), [*by, "island", "mz"])
    return one.unionByName(scan(parts, [*by, "start"], F.col("mz") * F.col("weight"), "weight", "top").groupBy(*by, "start").agg(*sums).drop("start"))


def fold(keys, mzs, weights, places, near, entry: tuple | None) -> tuple[list[int], tuple]:
    """(the place where each row's cluster begins, the state after the last row): state is (key, sum of mz * weight, sum of weights,
    the cluster's first place); entry is the one before the first row."""
    key, heavy, weight, start = entry or (None, 0.0, 0.0, 0)
    out = []
    for k, mz, w, at in zip(keys, mzs, weights, places):
        if k != key or abs(mz - heavy / weight) > near(heavy / weight):
            key, heavy, weight, start = k, 0.0, 0.0, at
        heavy, weight = heavy + mz * w, weight + w
        out.append(start)
    return out, (key, heavy, weight, start)


def fold_pieces(x: DataFrame, by: list[str], near, rows: int) -> DataFrame:
    """(by.., island, mz, start): the place where the cluster of each row of x (by.., island, mz, weight; a row per m/z) begins, as in one
    fold over each island in m/z order.

    Ordered rows are cut into pieces. Each is first folded as if nothing came before. A fold forgets what came before where a
    cluster begins, so nearly always a piece leaves with the same state whatever it was entered with: pieces are then folded
    again from the state that their predecessor left, as long as the state that they were entered with changes. The first piece is right at
    once and each round settles one more at least, so the rounds end, in practice after the second; a row a piece is all that passes between them.
    """
    kinds = dict(x.dtypes)
    of = [*by, "island", "mz"]
    x = in_pieces(x.withColumn("_key", F.xxhash64(*by, "island")), of, rows, "mz-pieces")
    state = "_key long, heavy double, weight double, start long"
    schema = ", ".join(["piece long", *[f"`{c}` {kinds[c]}" for c in of], state, "_first long, _exit boolean"])
    names = ["piece", *of, "_key", "heavy", "weight", "start", "_first", "_exit"]

    def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(before):
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("pos")
        entry = tuple(before[c].iloc[0] for c in ("_key", "heavy", "weight", "start"))  # column by column: one row of all would be of floats
        entry = None if pd.isna(entry[0]) else (int(entry[0]), float(entry[1]), float(entry[2]), int(entry[3]))
        start, last = fold(rows["_key"].tolist(), rows["mz"].tolist(), rows["weight"].tolist(), rows["pos"].tolist(), near, entry)
        out = rows[["piece", *of]].assign(_key=None, heavy=None, weight=None, start=start, _first=None, _exit=False)
        end = pd.DataFrame([[rows["piece"].iloc[0], *[None] * len(of), *last, rows["_key"].iloc[0], True]], columns=names)
        return pd.concat([out[names].astype(object), end.astype(object)], ignore_index=True)

    def folded(entries: DataFrame) -> DataFrame:
        return written(x.groupBy("piece").cogroup(entries.groupBy("piece")).applyInPandas(run, schema), "mz-folds")

    none = [F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in state.split(", ")]
    entered = written(x.select("piece").distinct().select("piece", *none), "mz-entries")
    found = folded(entered)
    line = Window.partitionBy(F.lit(0)).orderBy("piece")  # a row a piece
    while True:
        left = found.where("_exit").select("piece", "_first", "_key", "heavy", "weight", "start")
        prior = F.lag(F.struct("_key", "heavy", "weight", "start")).over(line)
        goes = left.withColumn("_p", prior).select("piece", *[F.when(F.col("_p._key") == F.col("_first"), F.col(f"_p.{c}")).alias(c) for c in ("_key", "heavy", "weight", "start")])
        now = written(goes, "mz-entries")
        was = entered.toDF("piece", *[f"_was_{c}" for c in entered.columns[1:]])
        alike = F.lit(True)
        for c in entered.columns[1:]:
            alike &= F.col(c).eqNullSafe(F.col(f"_was_{c}"))
        again = written(now.join(was, "piece").where(~alike).select(*now.columns), "mz-again")
        if not again.limit(1).count():
            return found.where("NOT _exit").select(*of, "start")
        found = found.join(again.select("piece"), "piece", "left_anti").select(*names).unionByName(folded(again).select(*names))
        entered = now


def candidate_mz(points: DataFrame, by: list[str], rt_start: float, rt_end: float, mz_min: float = 200.0, mz_max: float = 2000.0, ppm: float = 20.0, least: float = 1000.0, scans: int = 3, top: int = 50) -> DataFrame:
    """The `top` clusters by total intensity of an RT window, of at least `scans` scans."""
    x = points.where(F.col("rt").between(rt_start, rt_end) & F.col("mz").between(mz_min, mz_max))
    c = clusters(x, by, ppm, least=least).where(F.col("scan_count") >= scans)
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("total_intensity"), "cluster_mz"))
    return c.withColumn("candidate_rank", rank).where(F.col("candidate_rank") <= top)


class OpenGroups:
    """Groups of one island that a feature may still join, by cells of RT as wide as the tolerance.

    Features come in m/z order, so a group whose centre has fallen behind by more than the tolerance never gets another
    and is forgotten when its cell is next read: a feature looks at the groups of three cells that are within both tolerances, or nearly.
    """

    def __init__(self, ppm: float, rt_tolerance: float):
        self.ppm, self.reach, self.width = ppm, rt_tolerance, max(rt_tolerance, 1e-9) * 1.0001
        self.cells: dict[int, list[int]] = {}
        self.groups: list[list] = []  # sums of m/z and RT, size, samples

    def cell(self, rt: float) -> int:
        return int(rt // self.width)

    def join(self, who, mz: float, rt: float) -> int:
        """The number of the group that the feature joins, nearest by normalised distances, the oldest of several; a new one if there is none."""
        best, at, here = float("inf"), None, self.cell(rt)
        for c in (here - 1, here, here + 1):
            held = self.cells.get(c)
            if not held:
                continue
            alive = []
            for k in held:
                g = self.groups[k]
                centre, apex = g[0] / g[2], g[1] / g[2]
                tol = abs(centre) * self.ppm / 1e6
                if mz - centre > tol:
                    continue
                alive.append(k)
                if who not in g[3] and abs(mz - centre) <= tol and abs(rt - apex) <= self.reach:
                    far = abs(mz - centre) / max(tol, 1e-12) + abs(rt - apex) / max(self.reach, 1e-12)
                    if far < best or far == best and k < at:
                        best, at = far, k
            self.cells[c] = alive
        if at is None:
            at = len(self.groups)
            self.groups.append([0.0, 0.0, 0, set()])
            was = None
        else:
            was = self.cell(self.groups[at][1] / self.groups[at][2])
        g = self.groups[at]
        g[0], g[1], g[2] = g[0] + mz, g[1] + rt, g[2] + 1
        g[3].add(who)
        now = self.cell(g[1] / g[2])
        if now != was:
            if was is not None:
                self.cells[was].remove(at)
            self.cells.setdefault(now, []).append(at)
        return at


def gap_islands(features: DataFrame, mz_bin: Column, mz_gap: Column, rt_gap: float) -> DataFrame:
    """Adds island: features of different ones differ by more than mz_gap (a column over _before and _lo) in m/z or rt_gap in RT, through others too.

    Cut by m/z, then by RT, then by m/z again, as gaps open in what the first cuts leave. mz_bin is as for islands().
    """
    x = features.withColumn("_in", F.lit(""))
    rt_bin = F.floor(F.col("rt") / (max(rt_gap, 1e-9) / 2)).cast("long")
    for of, bin_, gap in (("mz", mz_bin, mz_gap), ("rt", rt_bin, lit(rt_gap)), ("mz", mz_bin, mz_gap)):
        cut = islands(x, ["_in"], of, bin_, gap).select("_in", "_bin", "island")
        x = x.withColumn("_bin", bin_).join(cut, ["_in", "_bin"]).withColumn("_in", F.concat_ws("/", "_in", "island")).drop("_bin", "island")
    return x.withColumnRenamed("_in", "island")


def match_features(features: DataFrame, ppm: float = 20.0, rt_tolerance: float = 0.2, least_samples: int = 1) -> DataFrame:
    """Adds feature_group_id to features (sample_id, mz, rt, area): in m/z order each joins the nearest group, by normalised distances
    to its means, that has no feature of its sample.

    A group's means lie between its features', so features across a gap wider than the tolerance, in m/z or RT, never meet: islands
    between such gaps are folded apart, many to a task.
    """
    features = written(features, "features")
    x = written(gap_islands(features, bins_of(ppm, 0.0), ppm_window(F.col("_before"), ppm), rt_tolerance), "features")
    batches = max(1, x.count() // 10_000)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["island", "mz", "rt", "sample_id"], kind="stable")
        of, last = [], None
        for island, who, mz, rt in zip(rows["island"], rows["sample_id"], rows["mz"], rows["rt"]):
            if island != last:
                last, groups = island, OpenGroups(ppm, rt_tolerance)
            of.append(groups.join(who, mz, rt))
        return rows.drop(columns="_batch").assign(_k=of)

    x = x.withColumn("_batch", F.pmod(F.xxhash64("island"), F.lit(batches))).groupBy("_batch").applyInPandas(fold, ", ".join(f"`{a}` {b}" for a, b in x.dtypes) + ", _k int")
    x = written(x, "matched")
    g = x.groupBy("island", "_k").agg(F.avg("rt").alias("_rt"), F.avg("mz").alias("_mz"), F.countDistinct("sample_id").alias("_who")).where(F.col("_who") >= least_samples)
    g = g.withColumn("feature_group_id", F.format_string("FG%04d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_rt", "_mz", "island", "_k"))))
    return x.join(g.select("island", "_k", "feature_group_id"), ["island", "_k"]).drop("island", "_k")


def feature_groups(matched: DataFrame, samples: DataFrame, rt_shift: float = 0.2, threshold: float = 2.0) -> DataFrame:
    """A row per group of matched features (feature_group_id, sample_id, mz, rt, area) over samples (sample_id, role: reference or
    target): means, presence, areas by sample, CV, fold change and difference type."""
    per = matched.groupBy("feature_group_id", "sample_id").agg(F.max("area").alias("area"))
    full = per.select("feature_group_id").distinct().crossJoin(F.broadcast(samples)).join(per.withColumn("present", F.lit(True)), ["feature_group_id", "sample_id"], "left")
    full = full.na.fill({"present": False}).withColumn("area", F.greatest(F.coalesce("area", lit(0)), lit(0)))
    of = lambda role, x: F.when(F.col("role") == role, x)
    g = full.groupBy("feature_group_id").agg(
        F.sum(F.col("present").cast("int")).cast("int").alias("sample_count"), F.sum((~F.col("present")).cast("int")).cast("int").alias("missing_sample_count"),
        cv_of_positives(F.col("area")).alias("cv"), F.max("area").alias("_max"), F.min(F.when(F.col("area") > 0, F.col("area"))).alias("_min"),
        F.coalesce(F.avg(of("reference", F.col("area"))), lit(0)).alias("_ref"), F.coalesce(F.avg(of("target", F.col("area"))), lit(0)).alias("_tar"),
        F.coalesce(F.max(of("reference", F.col("area") > 1)), F.lit(False)).alias("_rp"), F.coalesce(F.max(of("target", F.col("area") > 1)), F.lit(False)).alias("_tp"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_id", "present")))).alias("sample_presence"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_id", "area")))).alias("area_by_sample"),
    )
    m = matched.join(samples, "sample_id").groupBy("feature_group_id").agg(
        F.avg("mz").alias("representative_mz"), F.avg("rt").alias("representative_rt"), F.avg(of("reference", F.col("rt"))).alias("_rr"), F.avg(of("target", F.col("rt"))).alias("_tr")
    )
    g = g.join(m, "feature_group_id").withColumn("_fc", fold_change(F.col("_tar"), F.col("_ref")))
    shifted = F.coalesce(F.abs(F.col("_tr") - F.col("_rr")) > rt_shift, F.lit(False))
    g = g.withColumn("_d", group_difference(F.col("_rp"), F.col("_tp"), F.col("_fc"), shifted, threshold))
    return g.select(
        "feature_group_id", "representative_mz", "representative_rt", "sample_count", "missing_sample_count", "cv",
        F.coalesce(F.col("_max") / F.greatest(F.col("_min"), lit(1)), F.col("_fc")).alias("max_fold_change"), "_d.difference_type", "_d.confidence_score", "sample_presence", "area_by_sample",
    )


def feature_matrix(groups: DataFrame, sample_ids: list[str]) -> DataFrame:
    """One area column per sample beside the group's own columns."""
    fixed = [c for c in groups.columns if c not in ("sample_presence", "area_by_sample")]
    return groups.select(*fixed, *[F.try_element_at("area_by_sample", F.lit(s)).alias(f"area_{s}") for s in sample_ids])
