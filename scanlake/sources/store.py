"""Sinks: CSV and JSON exports, and the artifact store as Parquet tables."""

from __future__ import annotations

import json
import os
import time
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.operators.shared import in_pieces


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Quoted CSV; columns in digits get so many decimals, maps and arrays become JSON, nulls are empty."""
    for c, kind in df.dtypes:
        if digits and c in digits:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits[c]}f", F.col(c))))
        elif kind.startswith(("map", "array", "struct")):
            df = df.withColumn(c, F.to_json(c))
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def candidates_csv(candidates: DataFrame, path: str) -> None:
    write_csv(candidates, path, {"cluster_mz": 6, "total_intensity": 5, "max_intensity": 5})


def points_csv(points: DataFrame, path: str) -> None:
    write_csv(points.select("scan_id", "sample_id", "rt", "mz", "intensity"), path)


def feature_matrix_csv(groups: DataFrame, path: str, sample_ids: list[str]) -> None:
    """The nine fixed columns of feature groups and one area per sample, 0 where it has none."""
    fixed = {"feature_group_id": None, "representative_mz": 6, "representative_rt": 5, "sample_count": None, "missing_sample_count": None, "cv": 6, "max_fold_change": 6, "difference_type": None, "confidence_score": 4}
    areas = [F.coalesce(F.try_element_at("area_by_sample", F.lit(s)), F.lit(0.0)).alias(s) for s in sample_ids]
    write_csv(groups.select(*fixed, *areas), path, {c: d for c, d in fixed.items() if d is not None} | dict.fromkeys(sample_ids, 6))


def saved_features_csv(features: DataFrame, path: str) -> None:
    """Saved-feature records (views.cell_features) with six decimals; intensities and scans as JSON."""
    write_csv(features, path, {c: 6 for c, kind in features.dtypes if kind == "double"})


def cell_intensities_csv(traces: DataFrame, near: DataFrame, path: str, tolerance: float) -> None:
    """A row per cell and sample: its nearest scan (views.traces), what the scan and the grid hold there, relative to the largest, status."""
    x = traces.join(near, ["mz_index", "rt_index", "sample_id"], "left").na.fill({"raw": 0.0, "norm": 0.0})
    most = x.groupBy("mz_index", "rt_index").agg(F.max("raw").alias("_r"), F.max("norm").alias("_n"))
    x = x.join(most, ["mz_index", "rt_index"])
    percent = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(F.lit(0.0))
    x = x.select(
        "mz_index", "rt_index", F.col("sample_id").alias("sample"), "scan_id", F.col("raw_rt").alias("scan_raw_rt"), F.col("aligned_rt").alias("scan_aligned_rt"), F.col("rt_delta").alias("scan_rt_delta"),
        F.col("intensity").alias("scan_raw_intensity"), F.col("raw").alias("heatmap_raw_intensity"), F.col("norm").alias("normalized_intensity"), percent("raw", "_r").alias("raw_relative_pct"), percent("norm", "_n").alias("normalized_relative_pct"),
        F.lit(float(tolerance)).alias("mz_tolerance"), F.when(F.col("raw") > 0, "present").otherwise("missing").alias("status"),
    )
    write_csv(x, path, {c: 8 if c in ("scan_rt_delta", "normalized_intensity") else 6 for c, kind in x.dtypes if kind == "double"})


def auto_outputs(regions: DataFrame, matrix: DataFrame, folder: str) -> None:
    """Automatic regions as JSON and CSV, and their matrix as CSV, under folder."""
    write_json(regions, f"{folder}/auto_features_json")
    write_csv(regions, f"{folder}/auto_features_csv")
    write_csv(matrix, f"{folder}/auto_feature_matrix_csv")


def report(scans: DataFrame, candidates: DataFrame, features: DataFrame, groups: DataFrame, xics: DataFrame) -> dict[str, DataFrame]:
    """The report's payload as tables of JSON, a row each: samples (traces in RT order), candidates by sample (rank order), features by sample,
    groups (the most different and sure first) and their XICs by group, a trace a sample.

    scans (sample_id, rt, tic, bpi), candidates (sample_id, candidate_rank, ..), features and xics (feature_group_id, sample_id, rt, intensity).
    """
    trace = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    rest = lambda df, *but: [c for c in df.columns if c not in but]
    packed = lambda df, key, *c: df.groupBy(key).agg(F.to_json(trace(*c)).alias("payload_json"))
    samples = scans.groupBy("sample_id").agg(F.count(F.lit(1)).alias("scan_count"), F.to_json(F.struct(trace("rt", "tic").alias("tic"), trace("rt", "bpi").alias("bpc"))).alias("payload_json"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("difference_type") == "common_feature", F.desc("confidence_score"), "representative_rt", "feature_group_id")
    return {
        "samples": samples,
        "candidates_by_sample": packed(candidates, "sample_id", "candidate_rank", *rest(candidates, "sample_id", "candidate_rank")),
        "features_by_sample": packed(features, "sample_id", *rest(features, "sample_id")),
        "feature_groups": groups.select("feature_group_id", F.row_number().over(order).alias("place"), F.to_json(F.struct(*groups.columns)).alias("payload_json")),
        "xics_by_group": packed(xics.groupBy("feature_group_id", "sample_id").agg(trace("rt", "intensity").alias("trace")), "feature_group_id", "sample_id", "trace"),
    }


class Store:
    """Artifact tables under one folder, each a Parquet table partitioned by its key; saved features are a table of their own.

    write(replace=True) drops the keys that are not written again; otherwise only the written keys' partitions change.
    Saved features survive either way.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.kept: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.misses = 0

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, key: str, replace: bool = True) -> None:
        out = df.write.mode("overwrite").partitionBy(key)
        out.option("partitionOverwriteMode", "static" if replace else "dynamic").parquet(self._path(table))

    def read(self, table: str, **keys) -> DataFrame:
        """The table, or the partitions of the given key values."""
        x = self.spark.read.parquet(self._path(table))
        for k, v in keys.items():
            x = x.where(F.col(k) == v)
        return x

    def write_payload(self, tables: dict[str, DataFrame], keys: dict[str, str], replace: bool = True) -> None:
        """The grid payload split into artifact tables, each by its key: {"spectra": "sample_id", "heatmaps": "comparison", ...}."""
        for name, df in tables.items():
            self.write(name, df, keys[name], replace)

    def read_payload(self, keys: dict[str, str]) -> DataFrame:
        """(artifact_key, payload_json): the split tables put together again, an artifact per table and key, its rows as JSON in order.

        One artifact is one row, as its reader asks for it whole; larger ones are for write_parts and read_parts.
        """
        out = None
        for name, key in sorted(keys.items()):
            x = self.read(name)
            rows = F.sort_array(F.collect_list(F.struct(*[c for c in sorted(x.columns) if c != key])))
            x = x.groupBy(key).agg(F.to_json(rows).alias("payload_json")).select(F.concat(F.lit(name + ":"), F.col(key)).alias("artifact_key"), "payload_json")
            out = x if out is None else out.unionByName(x)
        return out

    def write_parts(self, table: str, df: DataFrame, key: str, order: list[str], part_bytes: int = 16 << 20, piece_rows: int = 1 << 18) -> None:
        """df as ordered parts of JSON rows under table, an artifact a value of key, for artifacts that are too large for one row: table_parts
        (artifact_key, part, first_row, rows, bytes, rows_json) and table_manifest (artifact_key, parts, rows, bytes).

        Rows are ordered in ranges of about piece_rows; a part is at most part_bytes of one artifact and range, or a single longer row.
        """
        x = df.select(F.col(key).cast("string").alias("artifact_key"), *order, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("_json"))
        x = in_pieces(x.drop(*[c for c in order if c == key]), ["artifact_key", *[c for c in order if c != key]], piece_rows, "parts")
        x = x.withColumn("_size", F.octet_length("_json").cast("long") + 1)
        line = Window.partitionBy("artifact_key", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        # by where a row begins and ends: a part's rows begin in one stretch of half the limit, the longer ones stand alone
        half = max(part_bytes // 2, 1)
        begins = F.sum("_size").over(line) - F.col("_size")
        long_ = F.col("_size") > half
        x = x.withColumn("_cut", F.floor(begins / half)).withColumn("_cut", F.when(long_, F.col("pos")).otherwise(F.col("_cut"))).withColumn("_long", long_)
        # a long row between two others ends the part before it
        x = x.withColumn("_run", F.sum(F.col("_long").cast("long")).over(line))
        parts = x.groupBy("artifact_key", "piece", "_run", "_long", "_cut").agg(
            F.min("pos").alias("_at"), F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_json"))), lambda r: r["_json"]), "\n").alias("rows_json")
        )
        parts.select("artifact_key", "_at", "rows", "bytes", "rows_json").write.mode("overwrite").parquet(self._path(f"{table}_written"))
        parts = self.read(f"{table}_written")
        of = Window.partitionBy("artifact_key").orderBy("_at")  # a row a part, without its text
        place = parts.select("artifact_key", "_at", "rows", "bytes").withColumn("part", F.row_number().over(of) - 1).withColumn("first_row", F.sum("rows").over(of) - F.col("rows"))
        out = parts.select("artifact_key", "_at", "rows_json").join(place, ["artifact_key", "_at"])
        out.select("artifact_key", "part", "first_row", "rows", "bytes", "rows_json").write.mode("overwrite").parquet(self._path(f"{table}_parts"))
        place.groupBy("artifact_key").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).write.mode("overwrite").parquet(self._path(f"{table}_manifest"))
        _remove(self.spark, self._path(f"{table}_written"))

    def read_parts(self, table: str, artifact: str, first: int = 0, rows: int | None = None) -> Iterator[dict]:
        """The rows of an artifact written by write_parts, in order, or `rows` of them from row `first` on: parts that hold some are read one at a time."""
        x = self.read(f"{table}_parts", artifact_key=artifact).where(F.col("first_row") + F.col("rows") > first)
        end = None if rows is None else first + rows
        if end is not None:
            x = x.where(F.col("first_row") < end)
        for part in [r["part"] for r in x.select("part").orderBy("part").collect()]:
            held = x.where(F.col("part") == part).first()
            for i, line in enumerate(held["rows_json"].split("\n"), held["first_row"]):
                if i >= first and (end is None or i < end):
                    yield json.loads(line)

    def cached(self, table: str, **keys) -> DataFrame:
        """read(), kept in the executors' memory and disks: the CACHED artifacts that were read last, by path, modification time and keys. A table
        that is written anew has another time, and what was kept of it goes."""
        path = self._path(table)
        stamp = _changed(self.spark, path)
        for old in [k for k in self.kept if k[0] == path and k[1] != stamp]:
            self.kept.pop(old).unpersist()
        name = (path, stamp, tuple(sorted(keys.items())))
        if name not in self.kept:
            self.kept[name] = self.read(table, **keys).persist()
            self.misses += 1
        self.kept.move_to_end(name)
        while len(self.kept) > CACHED:
            self.kept.popitem(last=False)[1].unpersist()
        return self.kept[name]

    def write_metadata(self, values: dict[str, str]) -> None:
        self.spark.createDataFrame(sorted(values.items()), "metadata_key string, metadata_value string").coalesce(1).write.mode("overwrite").parquet(self._path("metadata"))

    def features(self) -> DataFrame:
        """Saved features with readable JSON, by created_at and id; the newest whole version's rows."""
        last = max(self._marks("done"), default=None)
        if last is None:
            return self.spark.createDataFrame([], "feature_id string, feature_json string, created_at string, updated_at string")
        return self.spark.read.parquet(self._path(f"saved_features/version={last}")).where("try_parse_json(feature_json) IS NOT NULL").orderBy("created_at", "feature_id")

    def replace_features(self, new: DataFrame, now: str | None = None, patience: float = 600.0, keep: bool = False) -> int:
        """Replaces all saved features (see plans.matrices.upsert_features) and returns their number.

        A call claims the next version by a marker that only one writer can create, builds on the newest whole version, writes its own
        folder and marks it as whole; readers see whole versions alone. Another writer's claim is waited for, up to `patience` seconds, after which it counts as
        lost and the next number is claimed, so calls at one time follow one another. keep: features that new does not hold stay as they are.
        """
        from scanlake.plans.matrices import upsert_features

        version = self._claim(patience)
        folder = self._path(f"saved_features/version={version}")
        try:
            before = self.features()
            stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            out = upsert_features(before, new, stamp)
            if keep:
                out = out.unionByName(before.join(out.select("feature_id"), "feature_id", "left_anti").select(*out.columns))
            out.write.mode("overwrite").parquet(folder)
        except BaseException:
            _remove(self.spark, self._path(f"saved_features_marks/{version}.claim"))
            raise
        if version < max(self._marks("claim")):
            raise RuntimeError(f"version {version} took longer than a later writer would wait, and was given up")
        _create(self.spark, self._path(f"saved_features_marks/{version}.done"))
        return self.spark.read.parquet(folder).where("try_parse_json(feature_json) IS NOT NULL").count()

    def _marks(self, kind: str) -> list[int]:
        names = _listed(self.spark, self._path("saved_features_marks"))
        return [int(n.split(".")[0]) for n in names if n.endswith("." + kind)]

    def _claim(self, patience: float) -> int:
        began = time.time()
        while True:
            claims, done = max(self._marks("claim"), default=0), max(self._marks("done"), default=0)
            if claims <= done or time.time() - began > patience:
                if _create(self.spark, self._path(f"saved_features_marks/{max(claims, done) + 1}.claim")):
                    return max(claims, done) + 1
                began = time.time()  # another writer was first
            time.sleep(0.1)


#: Artifacts that a store keeps cached.
CACHED = 64


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _path(spark, path)
    fs.delete(jpath, True)


def _listed(spark: SparkSession, path: str) -> list[str]:
    jpath, fs = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(jpath)] if fs.exists(jpath) else []


def _changed(spark: SparkSession, path: str) -> int:
    """The latest modification time of a table's folder and files."""
    jpath, fs = _path(spark, path)
    times, files = [fs.getFileStatus(jpath).getModificationTime()], fs.listFiles(jpath, True)
    while files.hasNext():
        times.append(files.next().getModificationTime())
    return max(times)


def _create(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one. Of several writers one succeeds: stores create exclusively, local disks by the system's call."""
    jpath, fs = _path(spark, path)
    fs.mkdirs(jpath.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(unquote(urlparse(jpath.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()).path), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(jpath, False).close()
        return True
    except Exception:
        if fs.exists(jpath):
            return False
        raise
