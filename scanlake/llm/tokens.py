"""Token counts of documents in flat token files by a separator scan.

A flat file is nothing but little-endian ids, each document ended by a separator; it has no index, and blocks of it begin
and end anywhere. Every block is searched at once for separators; what it knows is its number of tokens and the places of
its separators. A prefix scan over the blocks of a file, in groups of
blocks and then over the groups, gives each block the tokens and separators before it and the place of the last separator,
which is what a document that straddles blocks needs.

Cases: an empty document has no tokens; tokens after the last separator of a file are a last document; a file without
tokens has none; null text is empty; null and repeated doc_ids are documents of their own; an empty table gives an
empty table; extra columns are ignored. Texts never give the separator's id, not even where they hold its name.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .packing import Encoder
from .words import slices

SEPARATOR = 50256
BLOCK = 1 << 16  # tokens of a block
GROUP = 1024  # blocks of a group in the prefix scan
KIND = "<u2"


def flatten(docs: DataFrame, separator: int = SEPARATOR, block: int = BLOCK, json_path=None, rank_path=None) -> DataFrame:
    """Rows of two kinds for docs (doc_id, text): (file, block, ids) of each task's flat stream, and, with block null,
    (file, ordinal, doc_id), the order of its documents."""

    names = ["file", "block", "ids", "ordinal", "doc_id"]

    def run(batches):
        from pyspark import TaskContext

        enc = Encoder(json_path, rank_path, names_as_text=True)
        file, rest, number, ordinal = TaskContext.get().partitionId(), np.zeros(0, KIND), 0, 0

        def put(flat):
            nonlocal number
            parts = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
            n, first = len(parts), number
            number += n
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(parts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, kind_of_id)], names)

        for b in slices(batches):
            flat = np.concatenate([rest, *[np.array([*enc.ids(t.as_py() or ""), separator], KIND) for t in b.column("text")]])
            n, whole = b.num_rows, len(flat) // block * block
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), b.column("doc_id")], names)
            ordinal, rest = ordinal + n, flat[whole:]
            yield put(flat[:whole])
        if len(rest):
            yield put(rest)

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of_id = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"file long, block long, ids binary, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}")


def read_files(spark: SparkSession, path: str, block: int = BLOCK, task_blocks: int = 1024) -> DataFrame:
    """(file, block, ids) of flat files, cut into blocks; file is the path. Spark lists the files; each task opens its file for
    one range of task_blocks blocks, so that a large file is many tasks.

    A store that Arrow's file systems don't open (they know local files, S3, GCS and HDFS) raises its error. A file that
    does not hold a whole number of ids raises ValueError; an empty file has no blocks.
    """
    width = np.dtype(KIND).itemsize
    span = block * width * task_blocks
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    ranges = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))))
    ranges = ranges.repartition(max(1, min(ranges.count(), 10_000)), "file", "at")  # the rows are tiny, the work behind them is not

    def cut(batches):
        from pyarrow import fs

        for b in batches:
            for f, size, at in zip(*(b.column(c).to_pylist() for c in ("file", "size", "at"))):
                if size % width:
                    raise ValueError(f"{f} does not hold a whole number of ids")
                local = f.removeprefix("file:")
                store, name = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(quote(f, safe=":/@"))
                with store.open_input_file(name) as x:
                    for lo in range(at, min(size, at + span), block * width * 16):
                        raw = x.read_at(min(block * width * 16, min(size, at + span) - lo), lo)
                        parts = [raw[i : i + block * width] for i in range(0, len(raw), block * width)]
                        first = lo // (block * width)
                        yield pa.RecordBatch.from_arrays([pa.array([f] * len(parts)), pa.array(range(first, first + len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["file", "block", "ids"])

    return ranges.mapInArrow(cut, "file string, block long, ids binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, n, seps, last, at): tokens, separators, the place of the last one (-1 without), and all their places."""

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), KIND)
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), int(at[-1]) if len(at) else -1, at))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["file", "block", "n", "seps", "last", "at"])

    return blocks.select("file", "block", "ids").mapInArrow(run, f"file {dict(blocks.dtypes)['file']}, block long, n long, seps long, last long, at array<long>")


def lengths(blocks: DataFrame, separator: int = SEPARATOR, group: int = GROUP) -> DataFrame:
    """(file, ordinal, start, n_tokens): every document of every file, in order; start is its place in the file."""
    x = materialize(scan_blocks(blocks, separator).withColumn("_g", F.floor(F.col("block") / group)), "tokens-blocks")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    inside, over = before(Window.partitionBy("file", "_g").orderBy("block")), before(Window.partitionBy("file").orderBy("_g"))
    x = x.withColumn("_n", zero(F.sum("n").over(inside))).withColumn("_s", zero(F.sum("seps").over(inside)))
    x = x.withColumn("_end", F.when(F.col("seps") > 0, F.col("_n") + F.col("last") + 1))  # place after the block's last separator, within the group
    x = x.withColumn("_open", F.max("_end").over(inside))
    g = x.groupBy("file", "_g").agg(F.sum("n").alias("n"), F.sum("seps").alias("s"), F.max("_end").alias("e"))
    g = g.withColumn("_gn", zero(F.sum("n").over(over))).withColumn("_gs", zero(F.sum("s").over(over)))
    g = g.withColumn("_ge", zero(F.max(F.col("_gn") + F.col("e")).over(over))).select("file", "_g", "_gn", "_gs", "_ge", (F.col("_gn") + F.col("n")).alias("_gt"), (F.col("_gn") + F.col("e")).alias("_gl"))
    y = x.join(g.select("file", "_g", "_gn", "_gs", "_ge"), ["file", "_g"])
    base = F.col("_gn") + F.col("_n")
    begin = F.coalesce(F.col("_gn") + F.col("_open"), F.col("_ge"))  # where the document that the block opens in began
    y = y.withColumn("_base", base).withColumn("_begin", begin)
    begins = lambda i: F.when(i == 0, F.col("_begin")).otherwise(F.col("_base") + F.get("at", i - 1) + 1)
    docs = F.transform("at", lambda x, i: F.struct(begins(i).alias("start"), (F.col("_base") + x - begins(i)).alias("n")))
    done = y.where("seps > 0").select("file", (F.col("_gs") + F.col("_s")).alias("_o"), F.posexplode(docs).alias("_i", "_d"))
    done = done.select("file", (F.col("_o") + F.col("_i")).alias("ordinal"), F.col("_d.start").alias("start"), F.col("_d.n").alias("n_tokens"))
    ends = g.groupBy("file").agg(F.max("_gt").alias("t"), zero(F.max("_gl")).alias("l"))
    seps = x.groupBy("file").agg(F.sum("seps").alias("s"))
    left = ends.join(seps, "file").where("t > l").select("file", F.col("s").alias("ordinal"), F.col("l").alias("start"), (F.col("t") - F.col("l")).alias("n_tokens"))
    return done.unionByName(left)


def count(docs: DataFrame, separator: int = SEPARATOR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) for every row of docs (doc_id, text), found in the flat files written of them."""
    small_batches(docs.sparkSession)
    flat = materialize(flatten(docs, separator, block), "tokens-flat")
    order = flat.where("block IS NULL").select("file", "ordinal", "doc_id")
    found = lengths(flat.where("block IS NOT NULL").select("file", "block", "ids"), separator, group)
    return order.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op9_token_counts(spark, sf_dir):
    return count(table(spark, sf_dir, "documents"))
