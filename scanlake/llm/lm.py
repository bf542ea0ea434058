"""Scores of whole texts by a gated recurrent language model, beside a unigram base.

Counts of all training tokens give the base and the vocabulary. The network knows the `head` commonest words, the end of
a text, and `tails` buckets of all other words by their last two characters; a bucket deals its probability to its words
by their counts + 1, with one more share for an unseen word. Texts are written once as symbols, which training and scoring
read. The network is trained in rounds on disjoint shares of the training texts, which add up to all of them: each
partition goes on from the last round's mean, by truncated back-propagation over windows with the state carried from
window to window of a text (of SEGMENT tokens of it), and the partitions' networks are averaged by their tokens, in levels of at most FAN_IN.
Scoring carries the state over the whole text.

Counts of the commonest `listed` words go to every executor (a fixed bound); the others are joined by hash.

Cases: null and empty texts are one end; null doc_id is a training text whose held_out is false; repeated rows count each
time; without training texts counts are zero and only the end and unseen words remain; an empty table gives an empty
table; extra columns are ignored. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, most_frequent, small_batches, table
from .gru import F32, Net, segments, windows
from .words import raw, slices, word_hashes, words

CHUNK = 1 << 14
FAN_IN = 7  # bits: partitions whose networks one task averages
MOST_ROWS = 1 << 22  # distinct words that a task holds before it passes its counts on
SLICE = 10 << 20  # bytes of symbols that are trained on or scored together: lanes of many texts, as long as the longest ones
SEGMENT = 512  # tokens over which training carries the state; scoring carries it over the whole text


def buckets(values: pa.Array, tails: int) -> np.ndarray:
    """Bucket of each word: by its last two characters."""
    d = pc.utf8_slice_codeunits(values, -2, 1 << 30).dictionary_encode()
    of = np.array([zlib.crc32(x.encode()) % tails for x in d.dictionary.to_pylist()], np.int64)
    return of[d.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)


def word_counts(docs: DataFrame, tails: int) -> DataFrame:
    """(h, bucket, n) over all texts; the end of text is h 0 in bucket -1."""

    def run(batches):
        held, rows, ends = [], 0, 0

        def out():
            nonlocal held, rows, ends
            h, b, n = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in range(3))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
            h, b, n = np.append(keys, 0), np.append(b[first], -1), np.append(total, ends)
            held, rows, ends = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["h", "bucket", "n"])

        for batch in slices(batches):
            d = words(batch.column("text"))[0].dictionary_encode()
            held.append((word_hashes(d.dictionary).view(np.int64), buckets(d.dictionary, tails), np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary))))
            rows, ends = rows + len(d.dictionary), ends + batch.num_rows
            if rows > MOST_ROWS:
                yield out()
        if ends:
            yield out()

    return docs.select("text").mapInArrow(run, "h long, bucket int, n long").groupBy("h", "bucket").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every executor knows of the counts. Symbols: head words by falling counts, then the end, then the tail buckets."""

    def __init__(self, listed: pd.DataFrame, totals: dict[int, tuple[int, int]], head: int, tails: int):
        ends = totals.get(-1, (0, 0))[0]
        self.n = sum(t for t, _ in totals.values())
        self.v = sum(u for b, (_, u) in totals.items() if b >= 0) + (ends > 0)
        self.ends, self.tails = ends, tails
        listed = listed.sort_values(["n", "h"], ascending=[False, True])
        h, n, b = (listed[c].to_numpy(np.int64) for c in ("h", "n", "bucket"))
        self.k = min(head, len(h))
        mass, kinds = np.zeros(tails), np.zeros(tails)
        for x, (t, u) in totals.items():
            if x >= 0:
                mass[x], kinds[x] = t, u
        np.subtract.at(mass, b[: self.k], n[: self.k])
        np.subtract.at(kinds, b[: self.k], 1)
        self.head_counts, self.rest_counts = n[: self.k], np.concatenate([[ends], mass])
        self.log_shares = np.log10(mass + kinds + 1.0)
        order = np.argsort(h, kind="stable")
        self.h, self.c = h[order], n[order]
        self.symbol = np.where(order < self.k, order, -1)

    def look_up(self, d: pa.Array):
        """(symbol, count or -1 where not listed, hash) of each word."""
        h = word_hashes(d).view(np.int64)
        c, s = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        if len(self.h):
            i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            ok = self.h[i] == h
            c[ok], s[ok] = self.c[i[ok]], self.symbol[i[ok]]
        tail = np.flatnonzero(s < 0)
        s[tail] = self.k + 1 + buckets(d.take(pa.array(tail)), self.tails)
        return s, c, h

    def tokens(self, texts):
        """(symbols of all tokens, ends included, offsets, counts, hashes: 0 for the end)."""
        flat, off = words(texts)
        d = flat.dictionary_encode()
        s, c, h = self.look_up(d.dictionary)
        at = d.indices.to_numpy().astype(np.int64)
        put = off[1:]
        return np.insert(s[at], put, self.k), off + np.arange(len(off)), np.insert(c[at], put, self.ends), np.insert(h[at], put, 0)


def _lanes(tokens: int, most: int) -> int:
    return int(min(most, max(4, tokens // 512)))


def _kind(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.k + 1 + vocabulary.tails <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, held_out, place, symbols, n_tokens, known, base, dealt, rest) for every row of docs (doc_id, text, held_out).

    symbols: a text's tokens for the network, as bytes. place: a hash in 0 .. 2^20 by which rounds take their share. base
    and dealt: log10 sums of the unigram base and of what buckets deal, over listed words; rest: the words that are not
    listed with their numbers, whose counts are joined.
    """
    kind = _kind(vocabulary)

    def run(batches):
        log_total = np.log10(vocabulary.n + vocabulary.v + 1)
        for b in slices(batches):
            ids, off, c, h = vocabulary.tokens(b.column("text"))
            n, texts = np.diff(off), b.num_rows
            of = np.repeat(np.arange(texts), n)
            own = np.log10(np.maximum(c, 0) + 1.0)  # of tokens that are not listed: 0 here, theirs is joined
            base = np.bincount(of, own, texts).astype(float) - n * log_total
            tail = ids > vocabulary.k
            dealt = np.bincount(of[tail], own[tail] - vocabulary.log_shares[ids[tail] - vocabulary.k - 1], texts).astype(float)
            open_ = np.flatnonzero(c < 0)
            order = open_[np.lexsort((h[open_], of[open_]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            lists = np.concatenate([[0], np.cumsum(np.bincount(of[order[first]], minlength=texts))])
            rest = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(h[order[first]]), pa.array(times)], ["h", "n"]))
            flat = ids.astype(kind)
            symbols = pa.array([flat[x:y].tobytes() for x, y in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("place"), symbols, pa.array(n), pa.array(np.bincount(of, c > 0, texts).astype(np.int64)), pa.array(base, pa.float64()), pa.array(dealt, pa.float64()), rest],
                ["doc_id", "held_out", "place", "symbols", "n_tokens", "known", "base", "dealt", "rest"],
            )

    doc_id = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", "held_out", F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(1 << 20)).alias("place"))
    return rows.mapInArrow(run, f"doc_id {doc_id}, held_out boolean, place long, symbols binary, n_tokens long, known long, base double, dealt double, rest array<struct<h:long,n:long>>")


def _symbols(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    data, off = raw(column.cast(pa.large_binary()))
    return data.view(kind).astype(np.int32), off // np.dtype(kind).itemsize


def rounds(rows: DataFrame, shares: tuple[float, ...]) -> list[DataFrame]:
    """The disjoint parts of rows (place), one a round; shares that add up to 1 leave no row out."""
    cuts = [round(x * (1 << 20)) for x in np.cumsum([0.0, *shares])]
    return [rows.where((F.col("place") >= a) & (F.col("place") < b)) for a, b in zip(cuts, cuts[1:])]


def _state(net: Net) -> np.ndarray:
    """Parameters and the sums of their squared gradients."""
    return np.concatenate([net.vector(), *[x.ravel() for x in net.g2.values()]]).astype(F32)


def _load(net: Net, v: np.ndarray) -> Net:
    net.load(v[: len(v) // 2])
    at = len(v) // 2
    for k, x in net.g2.items():
        net.g2[k] = v[at : at + x.size].reshape(x.shape).copy()
        at += x.size
    return net


def train(rows: DataFrame, vocabulary: Vocabulary, hidden: int, classes: int, shares: tuple[float, ...], rate: float, steps: int = 16, most_lanes: int = 512) -> Net:
    """The network after one round over each share of rows (place, symbols), in turn."""
    new = lambda: Net(vocabulary.head_counts, vocabulary.rest_counts, hidden, classes)
    net, kind = new(), _kind(vocabulary)
    for part in rounds(rows, shares):
        state = _state(net)

        def run(batches, state=state):
            from pyspark import TaskContext

            mine, weight = _load(new(), state), 0
            for b in slices(batches, "symbols", SLICE):
                ids, off = _symbols(b.column("symbols"), kind)
                last = None
                for x, keep, y, live, _ in windows(ids, segments(off, SEGMENT), _lanes(len(ids), most_lanes), steps):
                    h = np.zeros((x.shape[1], hidden), F32) if last is None else last[: x.shape[1]]
                    last, _ = mine.step(x, keep, y, live, h, rate)
                weight += len(ids)
            if weight:
                v = _state(mine)
                parts = [v[i : i + CHUNK].tobytes() for i in range(0, len(v), CHUNK)]
                own = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([own] * len(parts), pa.int32()), pa.array([float(weight)] * len(parts)), pa.array(parts, pa.binary())], ["chunk", "part", "weight", "v"])

        def mean(g: pd.DataFrame) -> pd.DataFrame:
            w = g["weight"].to_numpy()
            v = sum(np.frombuffer(x, F32).astype(float) * y for x, y in zip(g["v"], w)) / w.sum()
            return pd.DataFrame({"chunk": g["chunk"].iloc[:1], "part": g["part"].iloc[:1], "weight": [w.sum()], "v": [v.astype(F32).tobytes()]})

        nets = part.select("symbols").mapInArrow(run, "chunk int, part int, weight double, v binary")
        for level in (1, 2, 3):
            nets = nets.groupBy("chunk", F.shiftright("part", level * FAN_IN).alias("_p")).applyInPandas(mean, "chunk int, part int, weight double, v binary")
        got = nets.collect()  # a row per chunk, up to 2^21 partitions
        if got:
            _load(net, np.concatenate([np.frombuffer(r["v"], F32) for r in sorted(got, key=lambda r: r["chunk"])]))
    return net


def scores(rows: DataFrame, vocabulary: Vocabulary, net: Net, most_lanes: int = 512) -> DataFrame:
    """rows with symbols replaced by model: the network's log10 probability of each text's symbols."""
    params, hidden, kind, names = net.vector(), net.h, _kind(vocabulary), [c for c in rows.columns if c != "symbols"]

    def run(batches, classes=net.asked):
        mine = Net(vocabulary.head_counts, vocabulary.rest_counts, hidden, classes)
        mine.load(params)
        for b in slices(batches, "symbols", SLICE):
            ids, off = _symbols(b.column("symbols"), kind)
            total, last = np.zeros(b.num_rows), None
            for x, keep, y, live, text in windows(ids, off, _lanes(len(ids), most_lanes), 64):
                state = np.zeros((x.shape[1], hidden), F32) if last is None else last[: x.shape[1]]
                hs, last = mine.states(x, keep, state)
                total += np.bincount(text[live], mine.output(hs[live], y[live], False), b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(total / np.log(10))], [*names, "model"])

    schema = ", ".join(f"{k} {v}" for k, v in rows.dtypes if k != "symbols")
    return rows.mapInArrow(run, f"{schema}, model double")


def score(docs: DataFrame, held, head: int = 2048, tails: int = 32, listed: int = 1 << 18, hidden: int = 16, classes: int = 48, shares=(0.02, 0.08, 0.2, 0.3, 0.4), rate: float = 0.07, most_lanes: int = 512) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    held: a condition on docs; its texts are not learned from. shares: of the training texts, one per round.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held, F.lit(False)))
    counts = materialize(word_counts(docs.where(~F.col("held_out")), tails), "lm-counts")
    totals = {r["bucket"]: (r["t"], r["u"]) for r in counts.groupBy("bucket").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("u")).collect()}
    common = most_frequent(counts.where("bucket >= 0"), listed)
    cut = int(common["n"].min()) if len(common) else 1 << 62
    vocabulary = Vocabulary(common, totals, head, tails)
    rows = materialize(encoded(docs, vocabulary).withColumn("_row", F.monotonically_increasing_id()), "lm-symbols")
    net = train(rows.where(~F.col("held_out")), vocabulary, hidden, classes, shares, rate)
    rare = counts.where((F.col("n") < cut) & (F.col("bucket") >= 0)).select("h", F.col("n").alias("_c"))
    rest = rows.select("_row", F.explode("rest").alias("r")).select("_row", "r.h", "r.n").join(rare, "h")
    rest = rest.groupBy("_row").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("_c") + 1)).alias("_log"))
    out = scores(rows.select("_row", "doc_id", "held_out", "n_tokens", "known", "base", "dealt", "symbols"), vocabulary, net, most_lanes)
    out = out.join(rest, "_row", "left")
    more = F.coalesce("_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + F.col("dealt") + more).alias("score"),
    )


def op5_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
