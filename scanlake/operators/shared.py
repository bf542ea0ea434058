"""Tables between the jobs of one operator: written in the cluster's shared folder, ordered into pieces, broadcast when they are small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without one a folder of our own, which is then set. Elsewhere it must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scanlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from files in the shared folder, where its lineage ends; they go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 1 << 20, row_bytes: int = 64) -> DataFrame:
    """Hints a broadcast if df (written, of rows of about row_bytes: numbers and short names) has at most most_rows; else the planner shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most_rows * 64 else df


def in_pieces(df: DataFrame, line: list[str], rows: int, name: str) -> DataFrame:
    """df in the order of line, cut into about equal ranges: adds pos, rising with the order, and piece, the range's number. Rows that are
    alike in line are dealt over several ranges too, in any order."""
    df = written(df, name)  # so that numbers of rows hold when a task runs again
    n = max(1, -(-df.count() // rows))
    x = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *line, "_row").sortWithinPartitions(*line, "_row").drop("_row")
    return written(x.withColumn("pos", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("pos", 33)), name)


def islands(df: DataFrame, by: list[str], of: str, width: Column, tolerance: Column) -> DataFrame:
    """(by.., _bin, island, _lo, _hi): runs of column `of` without a gap wider than tolerance, a function of `_before`, the value before
    the gap, and `_lo`, the one after it.

    Rows are counted by `width` (a bin number, a function of the column, of bins no wider than the tolerance): gaps lie between
    bins, of which there are as many as the range has, whatever the number of rows. Rows find their island by bin.
    """
    bins = df.withColumn("_bin", width).groupBy(*by, "_bin").agg(F.min(of).alias("_lo"), F.max(of).alias("_hi"))
    line = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bin")
    bins = bins.withColumn("_before", F.lag("_hi").over(line))
    fresh = F.coalesce(F.col("_lo") - F.col("_before") > tolerance, F.lit(True)).cast("int")
    bins = bins.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*by, "island")
    return bins.select(*by, "_bin", "island", F.min("_lo").over(whole).alias("_lo"), F.max("_hi").over(whole).alias("_hi"))
