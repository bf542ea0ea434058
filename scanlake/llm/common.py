"""What the operators share: reading tables, cutting lineage in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; the same set as Arrow's ASCII white space.
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch for this session, so that texts reach Python by a few MB; words.slices() joins them again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, which is then set, but on a local master alone:
    elsewhere executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scanlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and any executor can read it again.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables; only when all that reads them is materialised in turn."""
    for t in tables:
        spark = t.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _width(field) -> object:
    """Column or number: about the bytes of one value."""
    kind = field.dataType
    if kind.typeName() in ("string", "binary"):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if kind.typeName() == "array":
        return F.coalesce(F.size(field.name), F.lit(0)) * 8 + 8
    return 8


def small_side(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Hints a broadcast if df, which must be materialised, has at most max_bytes (about 8 a value, 8 a row, strings and arrays by
    their length); else the planner shuffles and splits skew."""
    size = F.lit(8).cast("long")
    for f in df.schema.fields:
        size = size + _width(f)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes else df


def word_count(text):
    """Column: number of words of text; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE_RE), lambda w: w != "")), F.lit(0)).cast("long")


def most_frequent(counts: DataFrame, limit: int, least: int = 1):
    """The rows of counts (.., n) with the highest n as pandas, at most limit: all above a cut, found from the number of rows at
    each n (at most about the square root of the total, beyond 2^20 taken together)."""
    steps = counts.where(F.col("n") >= least).groupBy(F.least(F.col("n"), F.lit(1 << 20)).alias("n")).count().collect()
    cut, total = None, 0
    for r in sorted(steps, key=lambda r: -r["n"]):
        total += r["count"]
        if total > limit:
            break
        cut = r["n"]
    return (counts.where(F.col("n") >= cut) if cut is not None else counts.limit(0)).toArrow().to_pandas()
