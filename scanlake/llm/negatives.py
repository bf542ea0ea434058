"""Hard negatives by bit-sliced integer products.

Vectors are dealt into bounded blocks. In a block each component is an unsigned number over the block's least value, cut
into bit planes. An anchor reads the planes from the most significant on: after each, a candidate's score lies between
what the planes so far give with all further bits zero for positive weights and one for negative ones, and the reverse. The interval halves
with each plane; candidates whose interval cannot qualify any more are dropped, and those left after the last plane have exact
scores. Nothing is bounded by a guess: a candidate goes only if `k` others surely come before it, or if its interval misses
the wanted range.

Two searches are made of it. Positives: the k best rows of the anchor's label. Negatives: for each positive the k best rows of
other labels whose score lies in a range that follows from the positive's score; the block's best of each range meet in one ranking.

Cases: rows with null id, label or vector, or a null or non-finite component, take no part; vectors meet only those of as many
components; each row is an anchor or candidate of its own, so of rows that repeat an id every one is mined, and the others of its id are among its candidates; ties
go to the smaller id; a positive below zero has an empty range; one that scores 0 has those that score 0; anchors without positives give no rows; an empty table gives an
empty table. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table
from .topk import whole_vectors


class Planes:
    """Bit planes of one block of vectors: x = least + sum of 2^j * planes[j]."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.least = int(x.min(initial=0))
        above = (x - self.least).astype(np.uint64)
        self.bits = int(above.max(initial=0)).bit_length()
        self.planes = [((above >> np.uint64(j)) & np.uint64(1)).astype(np.float32) for j in range(self.bits)]
        self.most = max(abs(self.least), int(np.abs(x).max(initial=0)), 1)

    def search(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, ranges: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """([(places, scores) of the k best of rows by score, ties to smaller ids, whose score is low..high, for each (low, high)],
        number of plane products made)."""
        weight = int(np.abs(q).sum())
        kind = np.float32 if weight < 1 << 24 else np.float64 if weight < 1 << 53 else np.int64
        w = q.astype(kind)
        up, down = int(q[q > 0].sum()), int(q[q < 0].sum())
        at, score = rows, np.full(len(rows), self.least * int(q.sum()), np.int64)
        read = 0
        for j in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            score = score + ((self.planes[j] if len(at) == len(self.x) else self.planes[j][at]).astype(kind, copy=False) @ w).astype(np.int64) * (1 << j)
            read += len(at)
            rest = (1 << j) - 1
            low, high = score + down * rest, score + up * rest
            keep = np.zeros(len(at), bool)
            for a, b in ranges:
                may = (high >= a) & (low <= b)
                sure = low[(low >= a) & (high <= b)]
                if len(sure) >= k:  # that many surely lie in the range with at least this score
                    may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keep |= may
            if not keep.all():
                at, score = at[keep], score[keep]
        out = []
        for a, b in ranges:
            inside = np.flatnonzero((score >= a) & (score <= b))
            best = inside[np.lexsort((ids[at[inside]], -score[inside]))[:k]]
            out.append((at[best], score[best]))
        return out, read


ANY = (-(1 << 62), 1 << 62)


def vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v, _row): rows that take part, with floor(scale * x) of each component."""
    labelled = rows.where(F.col("label").isNotNull())
    keep = whole_vectors(labelled.select("vec_id", "embedding", "label"), scale, "label")
    return keep.withColumn("_row", F.monotonically_increasing_id())


class Grid:
    """Blocks of candidates and of anchors, each pair of which is a task's work."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, block: int, anchor_block: int):
        n, wanted = rows.count(), anchors.count()
        self.blocks = max(1, -(-n // block))
        least = min(wanted, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // self.blocks))
        self.anchor_blocks = max(1, -(-wanted // anchor_block), least)
        self.pairs = max(1, min(self.blocks * self.anchor_blocks, 10_000))
        self.rows = rows.withColumn("_b", self.deal(self.blocks, 1)).withColumn("_a", self.each(self.anchor_blocks))

    def deal(self, n: int, seed: int, row: str = "_row"):
        return F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n))

    def each(self, n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def meet(self, anchors: DataFrame, found, schema: str) -> DataFrame:
        """found(candidates, anchors) of each pair of blocks."""
        asked = anchors.withColumn("_aa", self.deal(self.anchor_blocks, 2, "_me")).withColumn("_bb", self.each(self.blocks))
        return self.rows.repartition(self.pairs, "_b", "_a").groupBy("_b", "_a").cogroup(asked.repartition(self.pairs, "_bb", "_aa").groupBy("_bb", "_aa")).applyInPandas(found, schema)


def matrices(have: pd.DataFrame, want: pd.DataFrame):
    """(rows, their planes, anchors, their matrix) for each number of components in both."""
    have_n, want_n = have["v"].map(len), want["w"].map(len)
    for n in sorted(set(have_n) & set(want_n)):
        h, w = have[have_n == n], want[want_n == n]
        yield h, Planes(np.array(h["v"].tolist(), np.int64).reshape(len(h), n)), w, np.array(w["w"].tolist(), np.int64).reshape(len(w), n)


class Rows:
    """Columns of whole numbers, gathered a few rows at a time."""

    def __init__(self, schema: str):
        self.names = [c.split(" ")[0] for c in schema.split(", ")]
        self.parts = [[np.zeros(0, np.int64)] for _ in self.names]

    def add(self, n: int, *values) -> None:
        for held, x in zip(self.parts, values):
            held.append(np.broadcast_to(np.asarray(x, np.int64), n))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(self.names, self.parts)})


POSITIVE = "_row long, anchor_id long, positive_id long, positive_score long, read long"
NEGATIVE = "_row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long, read long"


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 8192, anchor_block: int = 2048, read: bool = False) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of rows (vec_id, embedding, label) for which
    is_anchor holds and each of its best `positives` other rows of its label, the best `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    read: instead, (anchor_id, read, candidates): products of a candidate with one bit plane that an anchor's searches made, and about how many candidates there are.
    """
    rows = materialize(vectors(rows, scale), "negatives-vectors")
    anchors = rows.where(is_anchor).select(F.col("_row").alias("_me"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("kind"), F.col("v").alias("w"))
    grid = Grid(rows, anchors, block, anchor_block)

    def same(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = Rows(POSITIVE)
        for h, planes, w, q in matrices(have, want):
            ids, row, label = h["vec_id"].to_numpy(), h["_row"].to_numpy(), h["label"].to_numpy()
            by_label = {x: np.flatnonzero(label == x) for x in w["kind"].unique()}
            for me, anchor, mine, v in zip(w["_me"], w["anchor_id"], w["kind"], q):
                others = by_label[mine]
                [(at, score)], cost = planes.search(v, others[row[others] != me], ids, [ANY], positives)
                out.add(len(at), me, anchor, ids[at], score, cost)
        return out.frame()

    best = grid.meet(anchors, same, POSITIVE)
    first = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("positive_score"), "positive_id"))
    best = materialize(best.withColumn("place", first).where(F.col("place") <= positives), "negatives-positives")
    wanted = best.groupBy(F.col("_row").alias("_me")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("wanted"))  # at most `positives` each

    def different(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = Rows(NEGATIVE)
        for h, planes, w, q in matrices(have, want):
            ids, label = h["vec_id"].to_numpy(), h["label"].to_numpy()
            by_label = {x: np.flatnonzero(label != x) for x in w["kind"].unique()}
            for me, anchor, mine, v, asked in zip(w["_me"], w["anchor_id"], w["kind"], q, w["wanted"]):
                # whole numbers: the least and the largest score of a range
                ranges = [(-(-low * int(p["positive_score"]) // 100), high * int(p["positive_score"]) // 100) for p in asked]
                found, cost = planes.search(v, by_label[mine], ids, ranges, negatives)
                for p, (at, score) in zip(asked, found):
                    out.add(len(at), me, anchor, p["place"], p["positive_id"], p["positive_score"], ids[at], score, cost)
        return out.frame()

    found = grid.meet(anchors.join(small_side(materialize(wanted, "negatives-wanted")), "_me"), different, NEGATIVE)
    if read:
        cost = best.select("_row", "anchor_id", "read").unionByName(found.select("_row", "anchor_id", "read"))
        return cost.groupBy("_row", "anchor_id").agg(F.max("read").alias("read")).select("anchor_id", "read", F.lit(-(-rows.count() // grid.blocks)).alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("_row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
