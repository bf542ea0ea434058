"""Merkle manifests of data sets: a tree per source, and one over the sources' roots.

The forest is built as a monoid. Leaves are dealt into ranges of the order (source, id); a task folds its ranges to a
fragment: nodes that it cannot resolve, keyed by (tree, level, index). Fragments merge associatively: their nodes are
put together, and whenever all siblings of a run are there (the sizes of all trees are known, and so the arity of every
run), their parent takes their place. tree_reduce merges neighbouring fragments in rounds of `FAN`, each a grouping of
its own, until one fragment holds the root alone. A fragment has at most 2 * (arity - 1) nodes a level and tree at its two ends, however many rows it
stands for. The nodes of all fragments, written by the rounds, then give every range the siblings that it lacks, so that it
can prove and check each of its leaves by itself.

Cases: rows with null source are a source of their own, the first; null ids come first in theirs; rows that repeat an id are ordered
by leaf, equal rows in any order; null and empty values differ; an empty table gives an empty table and no root; further columns of the table are not read.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table

#: The tree over the sources' roots; its leaf i is the root of source i.
TOP = -1
#: Fragments that one task merges.
FAN = 32
Key = tuple[int, int, int]


def sha(x: bytes) -> bytes:
    return hashlib.sha256(x).hexdigest().encode()


def leaf_hash(*columns: Column) -> Column:
    """Hex SHA-256 of the columns, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    each = []
    for c in columns:
        c = c.cast("string")
        each.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*each), 256)


class Shape:
    """Numbers of nodes: widths(tree)[level], from the trees' numbers of leaves."""

    def __init__(self, leaves: dict[int, int], arity: int):
        self.leaves, self.arity, self.known = leaves, arity, {}

    def widths(self, tree: int) -> list[int]:
        if tree not in self.known:
            w = [self.leaves[tree]]
            while w[-1] > 1:
                w.append(-(-w[-1] // self.arity))
            self.known[tree] = w
        return self.known[tree]

    def name(self, tree: int, level: int, index: int) -> Key:
        """A tree's last node is a leaf of TOP."""
        return (TOP, 0, tree) if tree != TOP and level == len(self.widths(tree)) - 1 else (tree, level, index)

    def run(self, key: Key) -> range:
        """Indexes of the siblings that have one parent with key, itself among them."""
        tree, level, index = key
        first = index // self.arity * self.arity
        return range(first, min(first + self.arity, self.widths(tree)[level]))

    def parent(self, key: Key) -> Key | None:
        tree, level, index = key
        return self.name(tree, level + 1, index // self.arity) if self.widths(tree)[level] > 1 else None


def merge(a: dict[Key, bytes], b: dict[Key, bytes], shape: Shape) -> tuple[dict[Key, bytes], dict[Key, bytes]]:
    """(unresolved nodes of both, nodes that were made): associative, and commutative as keys say where nodes belong."""
    nodes, made, todo = a | b, {}, list(b)
    while todo:
        key = todo.pop()
        up = shape.parent(key)
        if key not in nodes or up is None:
            continue
        run = [(key[0], key[1], i) for i in shape.run(key)]
        if all(k in nodes for k in run):
            nodes[up] = made[up] = sha(b"".join([nodes.pop(k) for k in run]))
            todo.append(up)
    return nodes, made


def climb(tree: int, start: int, leaves: list[bytes], shape: Shape) -> tuple[list[tuple[int, list[bytes]]], dict[Key, bytes]]:
    """((first index, nodes) of each level of neighbouring leaves, unresolved nodes): what merge() gives of them, a level at a time."""
    levels, left, arity = [(start, leaves)], {}, shape.arity
    for level, w in enumerate(shape.widths(tree)):
        start, nodes = levels[-1]
        end = start + len(nodes)
        if w == 1:
            left[shape.name(tree, level, 0)] = nodes[0]
            break
        first = -(-start // arity)
        last = -(-end // arity) if end == w else end // arity
        if last <= first:
            left |= {(tree, level, start + i): x for i, x in enumerate(nodes)}
            break
        left |= {(tree, level, i): nodes[i - start] for i in (*range(start, first * arity), *range(min(last * arity, end), end))}
        levels.append((first, [sha(b"".join(nodes[p * arity - start : min(p * arity + arity, end) - start])) for p in range(first, last)]))
    return levels, left


class Part:
    """A range of leaves, folded. rows: in order, with source and leaf; place: rank of its first source, number of that source's leaves before it,
    leaves of its first and last source, number of sources."""

    def __init__(self, rows: pd.DataFrame, place: dict, arity: int):
        code = pd.factorize(rows["source"])[0]
        at = [0, *(i for i in range(1, len(code)) if code[i] != code[i - 1]), len(code)]
        self.blocks = [(int(place["rank"]) + i, int(place["before"]) if i == 0 else 0, a, b) for i, (a, b) in enumerate(zip(at, at[1:]))]
        leaves = {tree: b - a for tree, _, a, b in self.blocks} | {self.blocks[-1][0]: int(place["last"])} | {self.blocks[0][0]: int(place["first"]), TOP: int(place["sources"])}
        self.shape, self.levels, self.open = Shape(leaves, arity), {}, {}
        leaf, whole = [x.encode() for x in rows["leaf"]], []
        for tree, before, a, b in self.blocks:
            self.levels[tree], left = climb(tree, before, leaf[a:b], self.shape)
            if (TOP, 0, tree) in left:
                whole.append((tree, left[TOP, 0, tree]))
            else:
                self.open |= left
        if whole:  # neighbours: the first and last alone can be split
            self.levels[TOP], left = climb(TOP, whole[0][0], [x for _, x in whole], self.shape)
            self.open |= left

    def lacks(self) -> set[Key]:
        """Nodes on the way from the open ones to the root that others have, the roots among them."""
        out = {(TOP, 0, tree) for tree, *_ in self.blocks} | {(TOP, len(self.shape.widths(TOP)) - 1, 0)}
        seen = set()
        for key in self.open:
            while key is not None and key not in seen:
                seen.add(key)
                out |= {(key[0], key[1], i) for i in self.shape.run(key)}
                key = self.shape.parent(key)
        return out

    def node(self, key: Key, others: dict[Key, bytes]) -> bytes:
        tree, level, index = key
        held = self.levels.get(tree, ())
        if level < len(held) and 0 <= index - held[level][0] < len(held[level][1]):
            return held[level][1][index - held[level][0]]
        return others[key]

    def steps(self, others: dict[Key, bytes]):
        """For each leaf, [(siblings to the left, to the right)] of each level up to the root, and all of them in one."""
        memo = {}

        def above(key: Key) -> tuple[tuple, bytes]:
            up = self.shape.parent(key)
            if up is None:
                return (), b""
            held = memo.get(key[:2])
            if held is None or held[0] != key[2]:
                tree, level, index = key
                run = self.shape.run(key)
                left = b"".join([self.node((tree, level, i), others) for i in range(run.start, index)])
                right = b"".join([self.node((tree, level, i), others) for i in range(index + 1, run.stop)])
                rest, text = above(up)
                held = memo[key[:2]] = index, (((left, right), *rest), left + right + text)
            return held[1]

        for tree, before, a, b in self.blocks:
            for i in range(b - a):
                yield above(self.shape.name(tree, 0, before + i))


def fold(leaf: bytes, steps) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = sha(left + leaf + right)
    return leaf


class Manifest(NamedTuple):
    """leaves: the given rows with part and pos; nodes (tree, level, index, digest): of the fragments of all rounds; lacking (part, tree,
    level, index, and the part's place)."""

    leaves: DataFrame
    nodes: DataFrame
    lacking: DataFrame
    arity: int

    def root(self) -> str | None:
        row = self.nodes.where(F.col("tree") == TOP).orderBy(F.desc("level")).first()
        return row["digest"] if row else None


def tree_reduce(fragments: DataFrame, arity: int) -> DataFrame:
    """All nodes of fragments (part, tree, leaves, level, index, digest) and those made while neighbours merge, FAN at a time."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        shape = Shape(dict(zip(rows["tree"], rows["leaves"])), arity)
        shape.leaves[TOP] = int(rows["sources"].iloc[0])
        parts = [{(t, k, i): d.encode() for t, k, i, d in zip(g["tree"], g["level"], g["index"], g["digest"])} for _, g in rows.groupby("part", sort=True)]
        made: dict[Key, bytes] = {}

        def both(a, b):
            nodes, new = merge(a, b, shape)
            made.update(new)
            return nodes

        left = functools.reduce(both, parts, {})
        out = [(t, shape.leaves[t], k, i, d.decode(), (t, k, i) in left, (t, k, i) in made) for (t, k, i), d in (left | made).items()]
        out = pd.DataFrame(out, columns=["tree", "leaves", "level", "index", "digest", "open", "made"])
        return out.assign(part=rows["part"].iloc[0] // FAN, sources=shape.leaves[TOP])[KEPT + ["open", "made"]]

    nodes, last = fragments, fragments.agg(F.max("part")).first()[0] or 0
    while last > 0:
        merged = materialize(fragments.groupBy(F.floor(F.col("part") / FAN).alias("_to")).applyInPandas(meet, FRAGMENT + ", open boolean, made boolean"), "merkle-round")
        nodes = nodes.unionByName(merged.where("made").select(*KEPT))
        fragments, last = merged.where("open").select(*KEPT), last // FAN
    return nodes.select("tree", "level", "index", "digest")


KEPT = ["part", "tree", "leaves", "level", "index", "digest", "sources"]
FRAGMENT = "part long, tree long, leaves long, level int, index long, digest string, sources long"
PLACE = ("rank", "before", "first", "last", "sources")


def places(rows: DataFrame) -> DataFrame:
    """(part, rank, before, first, last, sources): see Part. Windows over a row or two a part."""
    key = F.struct(F.col("source").isNotNull().alias("some"), F.coalesce("source", F.lit("")).alias("source"))
    name = lambda c: F.sha2(F.concat(F.col(c)["some"].cast("string"), F.col(c)["source"]), 256)
    p = rows.groupBy("part", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    p = p.groupBy("part").agg(F.count(F.lit(1)).alias("d"), F.min("key").alias("a"), F.max("key").alias("b"), F.min_by("n", "key").alias("na"), F.max_by("n", "key").alias("nb"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    p = p.select("part", "d", name("a").alias("a"), name("b").alias("b"), "na", "nb").withColumn("same", F.coalesce(F.lag("b").over(line) == F.col("a"), F.lit(False)).cast("long"))
    p = p.withColumn("upto", F.sum(F.col("d") - F.col("same")).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.col("upto") - F.col("d"))
    p = p.withColumn("sources", F.max("upto").over(Window.partitionBy(F.lit(0))))
    ends = p.select("part", "sources", F.explode(F.when(F.col("d") == 1, F.array(F.struct(F.col("rank").alias("tree"), F.col("na").alias("n"), F.lit(True).alias("head"), F.lit(True).alias("tail")))).otherwise(
        F.array(F.struct(F.col("rank").alias("tree"), F.col("na").alias("n"), F.lit(True).alias("head"), F.lit(False).alias("tail")), F.struct((F.col("upto") - 1).alias("tree"), F.col("nb").alias("n"), F.lit(False).alias("head"), F.lit(True).alias("tail")))
    )).alias("e")).select("part", "sources", "e.*")
    of = Window.partitionBy("tree")
    ends = ends.withColumn("total", F.sum("n").over(of)).withColumn("before", F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    head, tail = F.col("head"), F.col("tail")
    return ends.groupBy("part").agg(F.max(F.when(head, F.col("tree"))).alias("rank"), F.max(F.when(head, F.col("before"))).alias("before"), F.max(F.when(head, F.col("total"))).alias("first"), F.max(F.when(tail, F.col("total"))).alias("last"), F.max("sources").alias("sources"))


def build(leaves: DataFrame, order: tuple[str, ...] = ("doc_id",), arity: int = 3, part_rows: int = 1 << 16) -> Manifest:
    """The manifest of leaves (source, leaf, the columns of order, others), in trees by source whose runs have `arity` nodes. A range holds
    about part_rows leaves; rows of one key are dealt over several by a number of their own."""
    leaves = materialize(leaves, "merkle-leaves")
    n = leaves.count()
    parts = max(1, -(-n // part_rows), min(n // 256, leaves.sparkSession.sparkContext.defaultParallelism))
    line = ["source", *order, "leaf", "_row"]
    rows = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *line).sortWithinPartitions(*line)
    rows = rows.drop("_row").withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33))
    rows = materialize(rows, "merkle-ordered")
    at = materialize(places(rows), "merkle-places")

    def fragment(rows: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*KEPT, "lacking"])
        part = Part(rows.sort_values("pos"), place.iloc[0].to_dict(), arity)
        out = [(t, part.shape.leaves.get(t, 0), k, i, d.decode(), False) for (t, k, i), d in part.open.items()]
        out += [(t, 0, k, i, None, True) for t, k, i in part.lacks()]
        out = pd.DataFrame(out, columns=["tree", "leaves", "level", "index", "digest", "lacking"])
        return out.assign(part=place["part"].iloc[0], sources=part.shape.leaves[TOP])[[*KEPT, "lacking"]]

    found = rows.select("part", "pos", "source", "leaf").groupBy("part").cogroup(at.groupBy("part")).applyInPandas(fragment, FRAGMENT + ", lacking boolean")
    found = materialize(found, "merkle-fragments")
    nodes = materialize(tree_reduce(found.where("NOT lacking").select(*KEPT), arity), "merkle-nodes")
    lacking = found.where("lacking").select("part", "tree", "level", "index").join(small_side(at), "part")
    return Manifest(rows, nodes, lacking, arity)


def prove(m: Manifest, altered: str | None = None, siblings: bool = False) -> DataFrame:
    """The leaves' rows with subroot, root, proof_sha256 (of the siblings level by level, left to right), folded_root and verified: from the
    column `altered` where that is not null, else from leaf. siblings: adds them too, as an array of strings."""
    given = [c for c in m.leaves.columns if c not in ("pos", "part")]
    others = m.lacking.join(small_side(m.nodes), ["tree", "level", "index"]).select("part", "tree", "level", "index", "digest", *PLACE)
    kinds, arity = dict(m.leaves.dtypes), m.arity
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in given], "subroot string, root string, proof_sha256 string, folded_root string, verified boolean", *["siblings array<string>"] * siblings])

    def check(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        out = {c: [] for c in ("subroot", "root", "proof_sha256", "folded_root", "verified", "siblings")}
        if not len(rows):
            return pd.DataFrame(out)
        part = Part(rows, near.iloc[0].to_dict(), arity)
        held = {(t, k, i): d.encode() for t, k, i, d in zip(near["tree"], near["level"], near["index"], near["digest"])}
        root = part.node((TOP, len(part.shape.widths(TOP)) - 1, 0), held)
        for tree, _, a, b in part.blocks:
            out["subroot"] += [part.node((TOP, 0, tree), held).decode()] * (b - a)
        now = rows["leaf"] if altered is None else rows[altered].where(rows[altered].notna(), rows["leaf"])
        for leaf, (steps, text) in zip(now, part.steps(held)):
            folded = fold(leaf.encode(), steps)
            out["proof_sha256"].append(hashlib.sha256(text).hexdigest())
            out["folded_root"].append(folded.decode())
            out["verified"].append(folded == root)
            if siblings:
                out["siblings"].append([text[i : i + 64].decode() for i in range(0, len(text), 64)])
        out["root"] = [root.decode()] * len(rows)
        return rows[given].assign(**{c: x for c, x in out.items() if siblings or c != "siblings"})

    return m.leaves.groupBy("part").cogroup(others.groupBy("part")).applyInPandas(check, schema)


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("altered"))
    return prove(build(rows), "altered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
