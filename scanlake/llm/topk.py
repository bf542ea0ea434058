"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into bounded blocks; in each block every dimension has a sorted list of its candidates. A query walks
the lists of its dimensions in step, each from the end where its own sign finds the largest terms, scores whatever it
meets, and stops when the sum of the terms at the lists' fronts cannot reach its kth score. The blocks' bests meet in
one ranking per query. Queries come in blocks too, so a task holds one block of each.

Cases: vectors that are null, or hold null or non-finite components, and rows with null vec_id take no part; vectors meet
only those of as many components; ties go to the smaller vec_id; each row is a query or candidate of its own, so that of
rows that repeat a vec_id every one has its k best others, and the other rows of its vec_id are among its candidates; an all-zero query scores 0 with all; fewer candidates than k give fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

OUT = "_row long, query_id long, vec_id long, score long, scored long"


class Lists:
    """The sorted lists of one block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")
        self.x, self.ids = x[by_id], ids[by_id]
        self.rows = (np.arange(len(ids)) if rows is None else rows)[by_id]
        order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, order, axis=0)
        self.order = np.ascontiguousarray(order.T)  # a row is a dimension's list
        self.float, self.single = self.x.astype(float), self.x.astype(np.float32)
        self.most = int(np.abs(self.x).max(initial=0))

    def top(self, q: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, scores, depth, count) of the k best but row `own`, ties to smaller ids; depth is how far the lists were walked,
        count how many candidates were scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        reach = self.most * int(np.abs(q).sum())  # no partial sum is larger; floats that hold all such numbers add exactly
        x = self.single if reach < 1 << 24 else self.float if reach < 1 << 53 else self.x
        y = q.astype(x.dtype)
        seen = self.rows == own
        at, score = [], []
        depth, kth, count = 0, None, 0
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - upto : n - depth]] = True
            met[self.order[down, depth:upto]] = True
            if not len(up) and not len(down):
                met[:] = True
                upto = n
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            at.append(fresh)
            score.append(((x @ y)[fresh] if 4 * len(fresh) > n else x[fresh] @ y).astype(np.int64))  # of many, reading all in order is faster
            count += len(fresh)
            depth, step = upto, step * 2
            if seen.all():
                break
            if count >= k and depth < n:
                if len(score) > 1:
                    score = [np.concatenate(score)]
                    at = [np.concatenate(at)]
                kth = np.partition(score[0], len(score[0]) - k)[len(score[0]) - k]
                bound = int(self.sorted[n - depth, up] @ q[up]) + int(self.sorted[depth - 1, down] @ q[down])
                if bound < kth:
                    break
        at, score = np.concatenate(at) if at else np.zeros(0, int), np.concatenate(score) if score else np.zeros(0, np.int64)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[best]], score[best], depth, count


def whole_vectors(vectors: DataFrame, scale: int, *also: str) -> DataFrame:
    """(vec_id, also.., v: array<long>): floor(scale * x) of every vector that takes part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *also, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, block: int = 16384, query_block: int = 4096, scored: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) for which is_query holds, its k best others.

    Blocks of queries are smaller than query_block where there would be fewer pairs of blocks than cores. scored: instead,
    (query_id, scored, candidates): the most candidates it scored in a block, of about how many.
    """
    rows = materialize(whole_vectors(vectors, scale).withColumn("_row", F.monotonically_increasing_id()), "topk-vectors")
    asked = rows.where(is_query)
    n, wanted = rows.count(), asked.count()
    blocks = max(1, -(-n // block))
    least = min(wanted, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    query_blocks = max(1, -(-wanted // query_block), least)
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.withColumn("_b", deal(blocks, 1)).withColumn("_q", each(query_blocks))
    asked = asked.select(deal(query_blocks, 2).alias("_qq"), each(blocks).alias("_bb"), F.col("_row").alias("_own"), F.col("vec_id").alias("query_id"), F.col("v").alias("w"))

    def meet(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("_row", "query_id", "vec_id", "score", "scored")})]
        if not len(have) or not len(want):
            return out[0]
        have_n, want_n = have["v"].map(len), want["w"].map(len)
        for n in sorted(set(have_n) & set(want_n)):
            h, w = have[have_n == n], want[want_n == n]
            lists = Lists(np.array(h["v"].tolist(), np.int64).reshape(len(h), n), h["vec_id"].to_numpy(), h["_row"].to_numpy())
            for own, row, q in zip(w["query_id"].tolist(), w["_own"].tolist(), np.array(w["w"].tolist(), np.int64).reshape(len(w), n)):
                ids, score, _, count = lists.top(q, row, k)
                out.append(pd.DataFrame({"_row": row, "query_id": own, "vec_id": ids, "score": score, "scored": count}))
        return pd.concat(out, ignore_index=True)

    pairs = max(1, min(blocks * query_blocks, 10_000))
    found = candidates.repartition(pairs, "_b", "_q").groupBy("_b", "_q").cogroup(asked.repartition(pairs, "_bb", "_qq").groupBy("_bb", "_qq")).applyInPandas(meet, OUT)
    if scored:
        return found.groupBy("_row", "query_id").agg(F.max("scored").alias("scored")).select("query_id", "scored", F.lit(-(-n // blocks)).alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
