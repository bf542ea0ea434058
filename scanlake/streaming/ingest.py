"""An extension: new centroid CSV files of a folder as a stream of points, with running chromatograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_CSV = "scan_id string, sample_id string, rt double, mz double, intensity double"


def stream_points(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(POINT_CSV).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def running_chromatogram(points: DataFrame) -> DataFrame:
    """(sample_id, scan_id, rt, tic, bpi), updated as files arrive."""
    return points.groupBy("sample_id", "scan_id", "rt").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpi"))


def append_points(points: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends points to a Parquet table partitioned by sample; returns it."""
    return points.writeStream.format("parquet").partitionBy("sample_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
