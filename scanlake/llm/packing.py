"""Best-fit packing of token sequences with swap-based local search.

Documents are tokenised where they are read; longer ones are cut into full sequences with the remainder in front. Small
rows (piece, length) go to bounded shards by hash; each shard is packed by best fit on falling lengths, then exchanges
between underfull bins (one item moved, one for one, two for one) raise the sum of squared fills until none is left to
make, which empties bins. Each shard leaves some underfull bins behind; the lightest of them meet in rounds of groups, in
each of which the same search goes on from the bins as they are, until one group holds what is left.

Cases: null text is empty, so a lone end id; an empty table gives an empty table; null or repeated doc_id and repeated
rows are packed one by one; extra columns are ignored. Sequence ids are shard * 2^32 + bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .words import slices, trim

END = 2


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file. Texts of ASCII and Latin letters go through the same ranks and
    pattern in the faster library, which gives the same ids (tests compare them); all others through the file itself. names_as_text: the names of
    special tokens in a text are ordinary text."""

    def __init__(self, json_path=None, rank_path=None, names_as_text: bool = False):
        import base64

        import public_tokenizers as P
        import tiktoken

        self.path, self._whole, self.names_as_text = json_path or P.path("byte_bpe_50k.json"), None, names_as_text
        with open(rank_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def whole(self):
        if self._whole is None:  # read where a text asks for it
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = self.names_as_text
        return self._whole

    @staticmethod
    def plain(text: str) -> bool:
        """Whether text is of ASCII and Latin letters, without the names and the space that the two libraries treat apart."""
        if "<|" in text:
            return False
        if text.isascii():
            return True
        try:
            return b"\x85" not in text.encode("latin-1")
        except UnicodeEncodeError:
            return "\x85" not in text and max(text) <= "ɏ"

    def ids(self, text: str) -> list[int]:
        if not self.plain(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, cap: int = 1024, json_path=None, rank_path=None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every row of docs (doc_id, text)."""

    def run(batches):
        enc = Encoder(json_path, rank_path)
        for b in slices(batches):
            rows, cols = [], ([], [], [], [])
            for i, t in enumerate(b.column("text")):
                ids = np.array([*enc.ids(t.as_py() or ""), END], "<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = (len(ids) - 1) % cap + 1 if not at else cap
                    rows.append(i)
                    for c, v in zip(cols, (piece, at, n, zlib.crc32(ids[at : at + n].tobytes()))):
                        c.append(v)
                    at, piece = at + n, piece + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that holds it."""
    open_at: list[list[int]] = [[] for _ in range(cap + 1)]  # bins by free space
    free, bins = 0, []  # free: bit r is set if some bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                free &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = cap, len(bins)
            bins.append([i])
        if r - s:
            open_at[r - s].append(b)
            free |= 1 << (r - s)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Exchanges between underfull bins until none raises the sum of squared fills, or no bin can be saved any more.

    The donor is the lightest bin that has not failed since the last change; what it gives makes another bin, at least
    as full, fuller: an item moved, an item against a smaller one, two items against one smaller than both together.
    """
    fill = [int(sizes[b].sum()) for b in bins]
    least = -(-int(sizes.sum()) // cap)
    live = [k for k in range(len(bins)) if fill[k] < cap]
    count, gone, tried = len(bins), set(), set()
    while count > least:
        donors = [k for k in live if k not in gone and k not in tried]
        if not donors:
            break
        a = min(donors, key=lambda k: (fill[k], k))
        others = np.array([k for k in live if k not in gone and k != a and fill[a] <= fill[k] < cap])
        if not len(others):
            tried.add(a)
            continue
        room = cap - np.array([fill[k] for k in others])
        items = [(j, q) for q, k in enumerate(others.tolist()) for j in bins[k]]
        size = sizes[[j for j, _ in items]]
        spare = room[[q for _, q in items]]
        best = None  # (gain, given items, taken item or None, bin)
        mine = sorted(bins[a], key=lambda i: -sizes[i])
        for i in mine:
            s = int(sizes[i])
            ok = np.flatnonzero(room >= s)
            if len(ok):
                q = ok[np.argmin(room[ok])]
                best = (s, [i], None, int(others[q]))
                break
        if best is None:
            gives = [([i], int(sizes[i])) for i in mine] + [([i, j], int(sizes[i] + sizes[j])) for x, i in enumerate(mine) for j in mine[x + 1 :]]
            for given, s in gives:
                d = s - size
                d = np.where((d > 0) & (d <= spare), d, 0)
                x = int(np.argmax(d))
                if d[x] and (best is None or d[x] > best[0]):
                    best = (int(d[x]), given, items[x][0], int(others[items[x][1]]))
        if best is None:
            tried.add(a)
            continue
        gain, given, taken, b = best
        for i in given:
            bins[a].remove(i)
            bins[b].append(i)
        if taken is not None:
            bins[b].remove(taken)
            bins[a].append(taken)
        fill[a] -= gain
        fill[b] += gain
        tried.clear()
        if not fill[a]:
            gone.add(a)
            count -= 1
    return [b for b in bins if b]


def _places(bins: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        where[b] = k
        offset[b] = np.cumsum(sizes[b]) - sizes[b]
    return where, offset


def pack_sizes(sizes, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    sizes = np.asarray(sizes, np.int64)
    return _places(local_search(best_fit(sizes, cap), sizes, cap), sizes)


def _light(where: np.ndarray, sizes: np.ndarray, cap: int, share: int) -> np.ndarray:
    """Which items lie in the lightest bins: one of `share` bins and one more, underfull ones only."""
    fill = np.bincount(where, sizes)
    light = np.zeros(len(fill), bool)
    light[np.argsort(fill, kind="stable")[: len(fill) // share + 1]] = True
    return (light & (fill < cap))[where]


def pack(docs: DataFrame, cap: int = 1024, shard_pieces: int = 4096, json_path=None, rank_path=None, light_share: int = 512, meet: int = 16) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset). A shard, a task's group, has about shard_pieces rows.

    light_share: of so many bins of a shard, the lightest goes on to the next round, where `meet` shards meet (1: no rounds).
    """
    small_batches(docs.sparkSession)
    got = materialize(pieces(docs, cap, json_path, rank_path).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    shards = max(1, -(-got.count() // shard_pieces))
    got = got.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    out = [c for c in got.columns if c not in ("_row", "_shard")]
    schema = ", ".join(f"{k} {v}" for k, v in got.dtypes) + ", sequence_id long, offset long, _light boolean"

    def placed(rows: pd.DataFrame, shard: int, where: np.ndarray, offset: np.ndarray, cap_: int, first: bool) -> pd.DataFrame:
        rows["sequence_id"], rows["offset"] = (shard << 32) + where, offset
        rows["_light"] = _light(where, rows["length"].to_numpy(), cap_, light_share if first else min(16, light_share))
        return rows

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        where, offset = pack_sizes(rows["length"].to_numpy(), cap)
        rows = placed(rows, int(rows["_shard"].iloc[0]), where, offset, cap, True)
        trim()
        return rows

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Goes on from the bins that meet here; the round's shards have numbers of their own."""
        rows = rows.sort_values(["sequence_id", "offset"], ignore_index=True)
        sizes = rows["length"].to_numpy()
        _, where = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        cuts = np.searchsorted(where, np.arange(where.max() + 2))
        bins = local_search([list(range(a, b)) for a, b in zip(cuts, cuts[1:])], sizes, cap)
        where, offset = _places(bins, sizes)
        rows["_shard"] = key[0]
        return placed(rows.drop(columns=["_to", "_number"]), key[1], where, offset, cap, False)

    done, number, groups = materialize(got.groupBy("_shard").applyInPandas(one, schema), "pack-shards"), shards, shards
    parts = []
    while groups > 1 and meet > 1:
        parts.append(done.where("NOT _light"))
        groups = -(-groups // meet)
        met = done.where("_light").withColumn("_to", F.floor(F.col("_shard") / meet)).withColumn("_number", F.lit(number) + F.col("_to"))
        done = materialize(met.groupBy("_to", "_number").applyInPandas(again, schema), "pack-met")
        number += groups
    for x in parts:
        done = done.unionByName(x)
    return done.select(*out, "sequence_id", "offset")


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
