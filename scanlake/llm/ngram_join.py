"""N-gram Jaccard join by the size-aware light/heavy method, as connected components.

Sets are a text's distinct word shingles; equal sets are one class with the least doc_id as its representative. Shingles
have one global order, rare before frequent. Any order is right; this one is known from two tables of fixed size, made from all
texts and broadcast: the most frequent shingles, which come last, and, for the part of the hash space that prefixes are taken from,
how many occurrences fell in each slot. A passage that many unlike texts share is no task's frequent one, but its slots are full, so it
leaves the prefixes and makes no list. Two sets that link share two of their first n - t + 2 shingles, t being the least overlap
a set of n can link with. Light sets (small ones) therefore emit all 2-subsets of that prefix; heavy sets are looked for
in its inverted lists; light sets that heavy ones could link with stand in those lists too. The boundary is where emitting
subsets costs more than scanning lists.

Lists of at most `short` classes give their pairs, which go on where they share two lists or a 2-subset: unlike texts meet
in one list by chance, the more the longer lists are. A pair that shares a longer list needs no other. That one is not expanded: it gives its leader, the member with
most frequent shingles, against each member; leaders' links are verified and make components. What is then in one
component need not be compared; only members outside their leader's component are compared with the rest of their list,
in tiles of bounded size that return a spanning forest of the links found. So every link between
different texts is either verified or joins what is joined already, and components are those of all links.

Pairs are refused early by a lossless bound: counts of shingles by hash bucket differ by at most the symmetric difference.

Cases: null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle have one, the
whole sequence; rows that share a doc_id are one document for links; rows with null doc_id have a null component and link
with nothing; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, most_frequent, small_batches, small_side, table
from .components import components
from .words import mixed, slices, window_hashes, word_hashes, words

MOST_FREQUENT, LEAST_FREQUENT = 1 << 18, 4
MOST_HELD = 1 << 21  # shingles that a task counts at once
SLOTS, CHUNK = 1 << 22, 1 << 13  # counters of the slot table, and of one row of it
MOST_COMPARED = 1 << 19  # shingles of the sets that a task's group compares, about
BINS = 128
ROW_COST = 20.0  # compares in a list that cost as much as one emitted row


def _sorted_within(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """keys, which lie owner by owner, n of each, sorted within each owner."""
    ends, keys = np.cumsum(n).tolist(), keys.copy()
    for lo, hi in zip([0, *ends], ends):
        keys[lo:hi].sort()
    return keys


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, distinct and sorted within each, owner of each)."""
    flat, off = words(texts)
    h, n = word_hashes(flat), np.diff(off)
    text = np.repeat(np.arange(len(n)), n)
    if len(h) >= width:
        ok = text[: len(h) - width + 1] == text[width - 1 :]
        keys, owner = window_hashes(h, width)[ok], text[: len(h) - width + 1][ok]
    else:
        keys, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in np.flatnonzero((n > 0) & (n < width)):
        keys = np.append(keys, mixed(window_hashes(h[off[i] : off[i + 1]], int(n[i])) ^ np.uint64(n[i])))
        owner = np.append(owner, i)
    if len(owner) > 1 and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    keys = _sorted_within(keys, np.bincount(owner, minlength=len(n)))
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[first], owner[first]


def _signed(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _part(num: int, den: int) -> np.uint64:
    """Hashes below this have slots: twice the share of a set that its prefix is, an eighth of all at least."""
    return np.uint64(min(1.0, max(2 * (den - num) / den, 1 / 8)) * ((1 << 64) - (1 << 12)))


def identities(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows of three kinds from one reading: (doc_id, n, k1, k2) of each text, with k1, k2 naming its set; with k2 null,
    (k1: shingle, n: its texts) where a task's part of the texts holds it twice or more; with counts (uint16, cut off at 65535) too,
    (k1: chunk, counts) of a task's part of the slot table."""
    names, part = ["doc_id", "n", "k1", "k2", "counts"], _part(num, den)

    def run(batches):
        held, rows, slots = [], 0, np.zeros(SLOTS, np.uint32)

        def seen():
            nonlocal held, rows
            ids, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ids, n = ids[n > 1], n[n > 1]
            held, rows = [], 0
            none = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n), _signed(ids), none, pa.nulls(len(ids), pa.binary())], names)

        for b in slices(batches):
            keys, owner = shingles(b.column("text"), width)
            n = np.bincount(owner, minlength=b.num_rows)
            ends = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(keys), dtype=np.uint64)])
                other = np.concatenate([[np.uint64(0)], np.cumsum(mixed(keys ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
                k1, k2 = total[ends[1:]] - total[ends[:-1]], other[ends[1:]] - other[ends[:-1]]
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n), _signed(k1), _signed(k2), none], names)
            np.add.at(slots, (keys[keys <= part] % np.uint64(SLOTS)).astype(np.int64), np.uint32(1))
            held.append(keys)
            rows += len(keys)
            if rows > MOST_HELD:
                yield seen()
        if rows:
            yield seen()
        chunks = np.minimum(slots, 65535).astype(np.uint16).reshape(-1, CHUNK)
        at = np.flatnonzero(chunks.any(1))
        for lo in range(0, len(at), 64):
            i = at[lo : lo + 64]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(i), none, pa.array([x.tobytes() for x in chunks[i]], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, counts binary")


def slot_levels(chunks: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each slot, level of what has no slot) from the rows of identities that have counts. Levels go by count; what has no
    slot stands behind the slots that hold the emptier three quarters of all occurrences."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.uint16)
        return pd.DataFrame({"k1": [group["k1"].iloc[0]], "counts": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})

    slots = np.zeros(SLOTS, np.int64)
    for r in chunks.select("k1", "counts").groupBy("k1").applyInPandas(add, "k1 long, counts binary").collect():
        slots[r["k1"] * CHUNK : (r["k1"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint32)
    by_count = np.sort(slots)
    held = np.cumsum(by_count)
    middle = int(by_count[np.searchsorted(held, held[-1] * 3 // 4)])
    shift = max(0, middle.bit_length() - 12)
    return (2 * np.minimum(slots >> shift, 0x7FF0)).astype(np.uint16), 2 * (middle >> shift) + 1


def _order(keys: np.ndarray, n: np.ndarray, part: np.uint64, levels: tuple[np.ndarray, int], frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, which keys are frequent): places are numbers that stand for shingles and ascend in the global order, sorted within each
    owner: by level, then hash, the frequent ones last, by rank. Should two shingles have one number, they count as one, twice."""
    slots, other = levels
    level = np.where(keys <= part, slots[(keys % np.uint64(SLOTS)).astype(np.int64)], np.uint16(other))
    places = (level.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16))
    common = np.zeros(len(keys), bool)
    if len(frequent):
        i = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        common = frequent[i] == keys
        places[common] = (np.uint64(0xFFFF) << np.uint64(48)) | ranks[i[common]]
    return _sorted_within(places, n), common


def light_boundary(sizes: list[tuple[int, int]], scanned: float, num: int, den: int) -> int:
    """The largest set size for which 2-subsets of the prefix are cheaper than lists. sizes: (size, classes)."""
    best, at, total = 0.0, 1, 0.0
    for n, c in sorted(sizes):
        p = n - -(-num * n // den) + 1
        total += c * (p * (p + 1) / 2 - p * (1 + scanned / ROW_COST))
        if total <= best:
            best, at = total, n
    return at


def signatures(reps: DataFrame, width: int, num: int, den: int, light: int, levels: tuple[np.ndarray, int], frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """Rows of two kinds for the sets of reps (doc_id, text): (sig, rep) for each subset and list entry, and, with sig null,
    (rep, n, cent: share of frequent shingles in thousandths, bins: counts by hash bucket, cut off at 255)."""
    part = _part(num, den)

    def run(batches):
        for b in slices(batches, most_bytes=2 << 20):
            keys, owner = shingles(b.column("text"), width)
            n = np.bincount(owner, minlength=b.num_rows)
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            places, common = _order(keys, n, part, levels, frequent, ranks)
            cent = np.bincount(owner, weights=common, minlength=b.num_rows) * 1000 // np.maximum(n, 1)
            bins = np.bincount(owner * BINS + (mixed(keys) % np.uint64(BINS)).astype(np.int64), minlength=b.num_rows * BINS)
            bins = np.minimum(bins, 255).astype(np.uint8).reshape(-1, BINS)
            place = np.arange(len(keys)) - begin[owner]
            prefix = np.minimum(n - -(-num * n // den) + 2, n)
            # list entries: of heavy sets, and of light ones whose partners can be heavy
            listed = (den * n > num * light)[owner] & (place < prefix[owner]) & (n > 1)[owner]
            sig, who = [mixed(places[listed])], [owner[listed]]
            # 2-subsets of the light sets' prefixes
            small = (n <= light) & (n > 1)
            for size in np.unique(prefix[small]):
                rows = np.flatnonzero(small & (prefix == size))
                i, j = np.triu_indices(size, 1)
                x, y = places[begin[rows][:, None] + i], places[begin[rows][:, None] + j]
                with np.errstate(over="ignore"):
                    sig.append(mixed(x * np.uint64(0x9E3779B97F4A7C15) + mixed(y)).ravel())
                who.append(np.repeat(rows, len(i)))
            sig, who = np.concatenate(sig), np.concatenate(who)
            rep, none = b.column("doc_id"), lambda kind: pa.nulls(len(sig), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([_signed(sig), pa.nulls(b.num_rows, pa.int64())]),
                    pa.concat_arrays([rep.take(pa.array(who)), rep]),
                    pa.concat_arrays([none(pa.int64()), pa.array(n)]),
                    pa.concat_arrays([none(pa.int64()), pa.array(cent.astype(np.int64))]),
                    pa.concat_arrays([none(pa.binary()), pa.array([x.tobytes() for x in bins], pa.binary())]),
                ],
                ["sig", "rep", "n", "cent", "bins"],
            )

    return reps.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "sig long, rep long, n long, cent long, bins binary")


def sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(x, keys: the set's sorted shingles as bytes) of the documents in wanted (x)."""

    def run(batches):
        for b in slices(batches):
            keys, owner = shingles(b.column("text"), width)
            off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([keys[off[i] : off[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["x", "keys"])

    wanted = small_side(materialize(wanted.select(F.col("x").alias("doc_id")).distinct(), "join-wanted"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return docs.mapInArrow(run, "x long, keys binary")


def _bins_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS).astype(np.int16)


def _verify(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Edges between a leader (rows with x = lead) and the members of its block."""
    own = group["x"] == group["lead"]
    out = []
    for lead in group[own]["keys"].unique():
        a = np.frombuffer(lead, np.uint64)
        for x, k in zip(group[~own]["x"], group[~own]["keys"]):
            b = np.frombuffer(k, np.uint64)
            same = np.intersect1d(a, b, assume_unique=True).size
            if den * same >= num * (len(a) + len(b) - same):
                out.append(x)
    return pd.DataFrame({"a": [group["lead"].iloc[0]] * len(out), "b": out}).astype("int64")


def tile_links(ka: list[np.ndarray], kb: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets that link. Only shingles on both sides count; they are numbered and multiplied in bands."""
    na, nb = np.array([len(x) for x in ka]), np.array([len(x) for x in kb])
    ta, tb = np.concatenate(ka), np.concatenate(kb)
    shared = np.intersect1d(ta, tb)
    same = np.zeros((len(ka), len(kb)), np.float32)
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]

        def matrix(t, n):
            m = np.zeros((len(n), len(part)), np.float32)
            i = np.minimum(np.searchsorted(part, t), len(part) - 1)
            ok = part[i] == t
            m[np.repeat(np.arange(len(n)), n)[ok], i[ok]] = 1
            return m

        same += matrix(ta, na) @ matrix(tb, nb).T
    same = same.astype(np.int64)
    return np.nonzero(den * same >= num * (na[:, None] + nb[None, :] - same))


def _close(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs' bucket counts are as near as those of sets that link; a quarter of the buckets is tried first."""
    most = (den - num) * (na[:, None] + nb[None, :]) // (den + num)
    ok = np.empty(most.shape, bool)
    for i in range(0, len(a), 64):
        ok[i : i + 64] = np.abs(a[i : i + 64, None, : BINS // 4] - b[None, :, : BINS // 4]).sum(2, dtype=np.int32) <= most[i : i + 64]
    i, j = np.nonzero(ok)
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        ok[x, y] = np.abs(a[x] - b[y]).sum(1, dtype=np.int32) <= most[x, y]
    return ok


def _sketch_tile(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """The rows of a tile that may link across components."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    out = [np.zeros(0, np.int64)]
    if len(left) and len(right):
        ok = _close(_bins_of(left["bins"]), left["n"].to_numpy(), _bins_of(right["bins"]), right["n"].to_numpy(), num, den)
        ok &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        out += [left["x"].to_numpy()[ok.any(1)], right["x"].to_numpy()[ok.any(0)]]
    return pd.DataFrame({"lead": group["lead"].iloc[0], "x": np.unique(np.concatenate(out))})


def _tile(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """A spanning forest, over components, of the links between a tile's stragglers (side 0) and members (side 1)."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    out = []
    if len(left) and len(right):
        i, j = tile_links([np.frombuffer(k, np.uint64) for k in left["keys"]], [np.frombuffer(k, np.uint64) for k in right["keys"]], num, den)
        pairs = np.unique(np.stack([left["component"].to_numpy()[i], right["component"].to_numpy()[j]], 1), axis=0)
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for x, y in pairs.tolist():
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def tiles(group: DataFrame, key: str, size: int, shingles: int = 1 << 62) -> DataFrame:
    """Rows of group (key, x, n, component, away, band and others) dealt to tiles (key, band, _near, i, j): the stragglers (away)
    of a band as side 0 against all rows of the bands next to it as side 1, each side cut into blocks of about `size` rows, and of
    sets of about `shingles` in all."""
    strays = group.where("away")
    cut = lambda g, name: g.groupBy(key, "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("n") / shingles)).cast("long").alias(name))
    met = cut(strays, "_a").withColumn("_near", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    met = materialize(met.join(cut(group, "_b").withColumnRenamed("band", "_near"), [key, "_near"]), "join-tiles")
    number = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    rest = [c for c in group.columns if c not in (key, "band", "away")]
    left = strays.join(met, [key, "band"]).select(key, "band", "_near", F.pmod(F.xxhash64("x"), F.col("_a")).alias("i"), number("_b").alias("j"), F.lit(0).alias("side"), *rest)
    right = group.withColumnRenamed("band", "_near").join(met, [key, "_near"])
    right = right.select(key, "band", "_near", number("_a").alias("i"), F.pmod(F.xxhash64("x"), F.col("_b")).alias("j"), F.lit(1).alias("side"), *rest)
    return left.unionByName(right)


def representatives(docs: DataFrame, rows: DataFrame, classes: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """docs whose doc_id is the rep of one of classes. Where those are too many to be broadcast, the other doc_ids of rows are found and left
    out, which are few unless copies are many; texts are shuffled only if both are many."""
    ids = classes.select(F.col("rep").alias("doc_id"))
    if ids.count() * 16 > max_bytes:
        others = materialize(rows.where("doc_id IS NOT NULL").select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "join-others")
        if others.count() * 16 <= max_bytes:
            return docs.where("doc_id IS NOT NULL").join(F.broadcast(others), "doc_id", "left_anti")
    return docs.join(small_side(ids, max_bytes), "doc_id", "left_semi")


def link(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, short: int = 32, tile: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text): links where den * |A and B| >= num * |A or B|.

    short: classes of a list up to which it gives all its pairs. tile: members of one side of a tile.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    both = materialize(identities(docs, width, num, den), "join-sets")
    rows = both.where("k2 IS NOT NULL").drop("counts")
    levels = slot_levels(both.where("counts IS NOT NULL"))
    common = materialize(both.where("k2 IS NULL AND counts IS NULL").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT), "join-frequent")
    common = most_frequent(common, MOST_FREQUENT)
    common["k1"] = common["k1"].to_numpy(np.int64).view(np.uint64) if len(common) else np.zeros(0, np.uint64)
    common = common.sort_values("k1")
    frequent, counts = common["k1"].to_numpy(np.uint64), common["n"].to_numpy(np.int64)
    ranks = np.zeros(len(counts), np.uint64)
    ranks[np.lexsort((frequent, counts))] = np.arange(len(counts), dtype=np.uint64)

    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("size")), "join-classes")
    sizes = [(r["n"], r["count"]) for r in classes.where("n <= 1000").groupBy("n").count().collect()]
    total = classes.agg(F.sum("n")).first()[0] or 1
    # an average list, each counted once: the few longest ones come last in the order and hardly stand in prefixes
    scanned = float(counts.mean()) * min(1.0, float(counts.sum()) / total) if len(counts) else 0.0
    light = light_boundary(sizes, scanned, num, den)

    reps = representatives(docs, rows, classes)
    signed = materialize(signatures(reps, width, num, den, light, levels, frequent, ranks), "join-signatures")
    facts = signed.where("sig IS NULL").select("rep", "n", "cent", "bins")
    entries = signed.where("sig IS NOT NULL").select("sig", "rep")
    lists = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    shared = materialize(entries.join(lists, "sig").join(facts.select("rep", "n", "cent"), "rep"), "join-lists")

    # short lists: all pairs; long ones: the leader against each member
    fits = (num * F.col("_n") <= den * F.col("n")) & (num * F.col("n") <= den * F.col("_n"))
    few = shared.where(F.col("_size") <= short).select("sig", "rep", "n")
    other = few.select("sig", F.col("rep").alias("_rep"), F.col("n").alias("_n"))
    pairs = few.join(other, "sig").where((F.col("rep") < F.col("_rep")) & fits).groupBy(F.col("rep").alias("lead"), F.col("_rep").alias("x"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("_lists"), F.max(F.greatest("n", "_n") <= light).alias("_light")).where("_lists > 1 OR _light").select("lead", "x")
    many = shared.where(F.col("_size") > short)
    lead = many.groupBy("sig").agg(F.max(F.struct("cent", (-F.col("rep")).alias("_r"), "n")).alias("_l")).select("sig", (-F.col("_l")["_r"]).alias("lead"), F.col("_l")["n"].alias("_n"))
    grouped = materialize(many.join(lead, "sig").select("sig", "lead", F.col("rep").alias("x"), "n", "_n"), "join-groups")
    star = grouped.where((F.col("lead") != F.col("x")) & fits).select("lead", "x")
    pairs = materialize(pairs.unionByName(star).distinct(), "join-pairs")
    discard(shared)

    def near(frames):
        for f in frames:
            if len(f):
                apart = np.abs(_bins_of(f["bins"]) - _bins_of(f["_bins"])).sum(1, dtype=np.int64)
                f = f[apart * (den + num) <= (den - num) * (f["_n"] + f["n"]).to_numpy()]
            yield f[["lead", "x", "n"]]

    close = pairs.join(facts.select(F.col("rep").alias("lead"), "bins", F.col("n").alias("_n")), "lead").join(facts.select(F.col("rep").alias("x"), F.col("bins").alias("_bins"), "n"), "x")
    close = materialize(close.mapInPandas(near, "lead long, x long, n long").distinct(), "join-close")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / 256), F.ceil(F.sum("n") / MOST_COMPARED))
    blocks = materialize(close.groupBy("lead").agg(parts.cast("long").alias("_blocks")), "join-blocks")
    members = close.join(blocks, "lead").select("lead", "x", F.pmod(F.xxhash64("x"), F.col("_blocks")).alias("_block"))
    members = members.unionByName(blocks.select("lead", F.col("lead").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")))
    keys = materialize(sets(docs, members, width), "join-keys")
    edges = materialize(members.join(keys, "x").groupBy("lead", "_block").applyInPandas(lambda g: _verify(g, num, den), "a long, b long"), "join-edges")
    discard(keys)

    # members outside their leader's component, against the rest of their list by bucket counts, then by sets
    found = materialize(components(edges), "join-components")
    group = grouped.join(found.select(F.col("node").alias("x"), F.col("component").alias("_c")), "x", "left").withColumn("component", F.coalesce("_c", "x"))
    group = group.join(found.select(F.col("node").alias("lead"), F.col("component").alias("_lc")), "lead", "left").withColumn("away", F.col("component") != F.coalesce("_lc", "lead"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("long")  # linked sizes differ by one band at most
    group = materialize(group.select("sig", "lead", "x", "n", "component", "away", band.alias("band")), "join-away")
    # the lists of one leader are compared one by one, or joined where that makes fewer pairs (many lists of the same members)
    size = group.groupBy("lead", "sig").agg(F.count(F.lit(1)).cast("double").alias("_c")).groupBy("lead").agg(F.sum(F.col("_c") * F.col("_c")).alias("_each"))
    members = group.select("lead", "x").distinct().groupBy("lead").agg(F.count(F.lit(1)).cast("double").alias("_all"))
    whole = materialize(members.join(size, "lead").where("_all * _all <= _each").select("lead", F.lit(True).alias("_whole")), "join-whole")
    listed = group.join(small_side(whole), "lead", "left").withColumn("sig", F.when(F.col("_whole"), F.xxhash64("lead")).otherwise(F.col("sig"))).drop("_whole")
    listed = listed.repartition("lead", "x").distinct()  # a leader's rows by their member: one that heads most lists is many tasks
    tile_of = ["band", "_near", "i", "j"]
    sketched = tiles(materialize(listed, "join-listed"), "sig", tile).join(facts.select(F.col("rep").alias("x"), "bins"), "x").repartition("sig", *tile_of)
    active = materialize(sketched.groupBy("sig", *tile_of).applyInPandas(lambda g: _sketch_tile(g, num, den), "lead long, x long").distinct(), "join-active")
    joined = found
    if active.limit(1).count():
        keys = materialize(sets(docs, active, width), "join-keys")
        few = group.drop("sig").repartition("lead", "x").distinct().join(active, ["lead", "x"], "left_semi")  # lists of one leader, joined
        left = tiles(few, "lead", tile, MOST_COMPARED).join(keys, "x").repartition("lead", *tile_of)
        more = materialize(left.groupBy("lead", *tile_of).applyInPandas(lambda g: _tile(g, num, den), "a long, b long").distinct(), "join-more")
        joined = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "join-all")
        discard(keys)
    discard(signed)

    # every row: its class's representative, the representative's component
    several = small_side(materialize(classes.where("size > 1").select("k1", "k2", "rep"), "join-several"))
    out = rows.join(several, ["k1", "k2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(small_side(joined.withColumnRenamed("node", "rep")), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def op7_ngram_join(spark, sf_dir):
    return link(table(spark, sf_dir, "documents"))
