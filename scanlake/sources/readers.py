"""Readers: centroid CSV, mzML, mock RAW placeholders, and directories of them, as scans."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.functions import sample_from_file_name
from scanlake.schema import RAW_FILE, SCAN

CSV_COLUMNS = ("scan_id", "sample_id", "rt", "mz", "intensity")
#: Product names that shorten sample ids, and mock features (m/z, RT) with their heights by product.
PRODUCTS = ("MabThera", "Reditux")
MOCK_FEATURES = ((548.3124, 4.80), (732.4411, 5.35), (914.5567, 5.90), (1102.6589, 6.55), (1264.7722, 7.10), (1430.8831, 7.65), (1625.9965, 8.25))


def _file_name():
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _ordered(scans: DataFrame) -> DataFrame:
    """Scans in SCAN's columns, sample_ord by sample id, scan_ord by rt and id within a sample."""
    order = scans.select("sample_id").distinct().withColumn("sample_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sample_id")) - 1)
    x = scans.join(order, "sample_id").withColumn("scan_ord", F.row_number().over(Window.partitionBy("sample_id").orderBy("rt", "scan_id")) - 1)
    return x.select(*[F.col(f.name) if f.name.endswith("_array") else F.col(f.name).cast(f.dataType).alias(f.name) for f in SCAN.fields])


def read_centroid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scans of CSV files with a header of scan_id, sample_id, rt, mz, intensity (a byte order mark is allowed), in row order.

    A file with several samples gives several samples, by its rows' sample_id.
    """
    x = spark.read.option("header", True).csv(path)
    x = x.toDF(*[c.lstrip("﻿").strip() for c in x.columns])
    if missing := set(CSV_COLUMNS) - set(x.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    x = x.select("scan_id", "sample_id", *[F.col(c).cast("double").alias(c) for c in ("rt", "mz", "intensity")], F.monotonically_increasing_id().alias("pos"), _file_name().alias("raw_file_id"))
    g = x.groupBy("raw_file_id", "sample_id", "scan_id", "rt").agg(
        F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak_intensity"), F.max_by("mz", F.struct("intensity", -F.col("pos"))).alias("base_peak_mz"), F.sort_array(F.collect_list(F.struct("pos", "mz", "intensity"))).alias("_l")
    )
    return _ordered(g.select("*", F.lit(1).alias("ms_level"), F.col("_l.mz").alias("mz_array"), F.col("_l.intensity").alias("intensity_array")))


_CV = "array<struct<_accession:string,_value:string>>"
SPECTRUM_XML = (
    f"_id string, _index long, cvParam {_CV}, scanList struct<cvParam:{_CV},scan:array<struct<cvParam:{_CV}>>>,"
    f" binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"
)


def decode_binary(data: str | None, accessions: list[str]) -> np.ndarray:
    """A binaryDataArray: base64, zlib with MS:1000574, 32-bit floats with MS:1000521, else 64-bit, little-endian."""
    raw = base64.b64decode(data or "")
    raw = zlib.decompress(raw) if "MS:1000574" in accessions else raw
    kind = np.dtype("<f4" if "MS:1000521" in accessions else "<f8")
    if len(raw) % kind.itemsize:
        raise ValueError(f"binary array of {len(raw)} bytes is not a whole number of values")
    return np.frombuffer(raw, kind).astype(float)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """MS1 spectra of mzML files, split at <spectrum>. Spectra without a start time are skipped; total and base peak intensity come from
    their cvParams or else from the points; m/z and intensity arrays must be equally long."""
    x = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM_XML).load(path).withColumn("raw_file_id", _file_name())
    blank = F.array().cast(_CV)
    params = F.concat(F.coalesce("cvParam", blank), F.coalesce("scanList.cvParam", blank), F.coalesce(F.flatten(F.col("scanList.scan.cvParam")), blank))
    value = lambda a: F.get(F.filter("_p", lambda p: p["_accession"] == a), F.lit(0))["_value"]
    number = lambda a: value(a).try_cast("double")
    level = F.coalesce(F.nullif(F.trim(value("MS:1000511")), F.lit("")).try_cast("int"), F.lit(1))
    x = x.withColumn("_p", params).withColumn("ms_level", level).withColumn("rt", number("MS:1000016")).where("ms_level = 1 AND rt IS NOT NULL")
    x = x.select("raw_file_id", F.col("_id").alias("scan_id"), "rt", "ms_level", number("MS:1000285").alias("tic"), number("MS:1000504").alias("base_peak_mz"), number("MS:1000505").alias("base_peak_intensity"), F.col("binaryDataArrayList.binaryDataArray").alias("_b"))

    def decode(frames):
        for f in frames:
            arrays: dict[str, list] = {"MS:1000514": [], "MS:1000515": []}
            for row in f["_b"]:
                have = {k: np.zeros(0) for k in arrays}
                for b in row if row is not None else []:
                    acc = [c["_accession"] for c in (b["cvParam"] if b["cvParam"] is not None else [])]
                    for k in arrays:
                        if k in acc:
                            have[k] = decode_binary(b["binary"], acc)
                if len(have["MS:1000514"]) != len(have["MS:1000515"]):
                    raise ValueError("m/z and intensity arrays differ in length")
                for k in arrays:
                    arrays[k].append(have[k])
            yield f.drop(columns="_b").assign(mz_array=arrays["MS:1000514"], intensity_array=arrays["MS:1000515"])

    kinds = ", ".join(f"{a} {b}" for a, b in x.dtypes if a != "_b")
    x = x.mapInPandas(decode, kinds + ", mz_array array<double>, intensity_array array<double>")
    total = F.aggregate("intensity_array", F.lit(0.0), lambda a, v: a + v)
    x = x.withColumn("tic", F.coalesce("tic", total)).withColumn("base_peak_intensity", F.coalesce("base_peak_intensity", F.array_max("intensity_array"), F.lit(0.0)))
    return _ordered(x.withColumn("sample_id", sample_from_file_name(F.col("raw_file_id"), PRODUCTS)))


def mock_scans(name: str) -> pd.DataFrame:
    """Scans for a .raw placeholder, the same for one file name: 260 scans from RT 3.5 by 0.025, seven Gaussian features and noise.

    A fixture generator of our own; the random numbers are seeded by the name's SHA-256.
    """
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
    tall = np.array([52, 41, 36, 30, 27, 22, 18]) * 1000.0 * (np.array([1, 1, 0.4, 2.2, 1, 0, 1]) if "Reditux" in name else 1)
    rows = []
    for i in range(260):
        rt = 3.5 + 0.025 * i
        signal = [(mz + rng.normal(0, 0.0008), h * np.exp(-0.5 * ((rt - at) / 0.07) ** 2)) for (mz, at), h in zip(MOCK_FEATURES, tall)]
        points = [(m, v) for m, v in signal if v > 100] + [(rng.uniform(300, 1800), rng.uniform(80, 650)) for _ in range(rng.integers(8, 17))]
        points.sort()
        mz, v = [p[0] for p in points], [p[1] for p in points]
        top = int(np.argmax(v))
        rows.append((f"{name}:{i + 1}", name, rt, 1, mz, v, float(np.sum(v)), mz[top], v[top]))
    return pd.DataFrame(rows, columns=["scan_id", "raw_file_id", "rt", "ms_level", "mz_array", "intensity_array", "tic", "base_peak_mz", "base_peak_intensity"])


def read_mock(spark: SparkSession, names: list[str]) -> DataFrame:
    kinds = "scan_id string, raw_file_id string, rt double, ms_level int, mz_array array<double>, intensity_array array<double>, tic double, base_peak_mz double, base_peak_intensity double"
    files = spark.createDataFrame([(n,) for n in names], "name string")
    x = files.mapInPandas(lambda frames: (pd.concat([mock_scans(n) for n in f["name"]]) for f in frames if len(f)), kinds)
    return _ordered(x.withColumn("sample_id", sample_from_file_name(F.col("raw_file_id"), PRODUCTS)))


READERS = {"csv": read_centroid_csv, "mzml": read_mzml}


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Files of the directory, of any store Spark reads, with a known suffix, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(s.getPath()) for s in found if s.isFile() and s.getPath().getName().rpartition(".")[2].lower() in (*READERS, "raw"))


def load_directory(spark: SparkSession, directory: str, project_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(raw files, scans) of all known files. Of several files with one sample the last by name gives the scans; all are raw files."""
    files = list_files(spark, directory)
    if not files:
        raise ValueError(f"no csv, mzml or raw file in {directory}")
    parts = []
    for suffix in ("csv", "mzml", "raw"):
        mine = [f for f in files if f.lower().endswith("." + suffix)]
        if mine:
            parts.append(read_mock(spark, [f.rpartition("/")[2] for f in mine]) if suffix == "raw" else READERS[suffix](spark, mine))
    scans = parts[0]
    for p in parts[1:]:
        scans = scans.unionByName(p)
    raw = raw_files(scans, project_id)
    last = scans.groupBy("sample_id").agg(F.max("raw_file_id").alias("raw_file_id"))
    return raw, scans.join(last, ["sample_id", "raw_file_id"]).select(*SCAN.names)


def raw_files(scans: DataFrame, project_id: str = "") -> DataFrame:
    """A row per raw file: m/z and RT ranges and scan count, zeros where empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = scans.groupBy("raw_file_id").agg(
        F.max("sample_id").alias("sample_id"), zero(F.min(F.array_min("mz_array"))).alias("mz_min"), zero(F.max(F.array_max("mz_array"))).alias("mz_max"),
        zero(F.min("rt")).alias("rt_min"), zero(F.max("rt")).alias("rt_max"), F.count(F.lit(1)).alias("scan_count"),
    )
    x = x.withColumns({"project_id": F.lit(project_id), "file_name": F.col("raw_file_id"), "file_path": F.col("raw_file_id"), "data_format": F.lower(F.element_at(F.split("raw_file_id", r"\."), -1)), "parser_status": F.lit("parsed")})
    return x.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_FILE.fields])
