"""The Merkle manifest against a plain tree, on awkward tables, and its fragments as a monoid."""

import collections
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from scanlake.llm import merkle

KINDS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def plain(nodes, arity=3):
    """(root, proof of each: [(left, right)])"""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k // arity * arity
            proofs[i].append(("".join(level[first:k]), "".join(level[k + 1 : first + arity])))
        level, at = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [k // arity for k in at]
    return level[0], proofs


def expected(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees.append(plain([x[2] for x in by[s]]))
    if not trees:
        return []
    root, tops = plain([t[0] for t in trees])
    out = []
    for s, (sub, proofs), top in zip(names, trees, tops):
        for (_, _, leaf, r), proof in zip(by[s], proofs):
            steps = proof + top
            now = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                now = leaf_of(r, r["text"].replace("\n", ""))
            for a, b in steps:
                now = h(a, now, b)
            out.append((r["doc_id"], leaf, sub, root, h(*[x for step in steps for x in step]), now, now == root))
    return out


def table_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def some_rows(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    texts = [None, "", "a\nb", "plain", "ü\n\nß", "long \n" * 20_000]
    return [(int(i), texts[rng.integers(6 if i % 50 == 0 else 5)], [None, "en", ""][rng.integers(3)], sources[rng.integers(len(sources))], [None, 7][rng.integers(2)], "x", 1, "y") for i in rng.permutation(n)]


def check(spark, tmp_path, rows, **sizes):
    names = [c.split(" ")[0] for c in KINDS.split(", ")]
    want = expected([dict(zip(names, r)) for r in rows])
    df = merkle.op11_merkle_manifest(spark, table_of(spark, tmp_path, rows))
    got = [tuple(r) for r in df.collect()]
    assert collections.Counter(got) == collections.Counter(want)
    return got


def test_awkward_rows(spark, tmp_path):
    rows = some_rows(400, [None, "", "a", "b", "é", "Z"])
    rows += rows[:40] + [(None, "x\ny", None, "a", None, None, None, None)] * 3 + [(7, "other", "de", "lone", 1, None, None, None)]
    got = check(spark, tmp_path, rows)
    assert {True, False} == {r[-1] for r in got}


def test_one_source_and_one_row(spark, tmp_path):
    check(spark, tmp_path / "a", some_rows(100, ["only"]))
    got = check(spark, tmp_path / "b", [(2, "t", None, None, 1, "x", 1, "y")])
    assert got[0][1] == got[0][2] == got[0][3]  # a lone leaf is subroot and root


def test_a_source_a_row(spark, tmp_path):
    rows = [(i, "t\n", None, f"s{i}", 1, "x", 1, "y") for i in range(300)]
    check(spark, tmp_path, rows)


def test_empty(spark, tmp_path):
    assert merkle.op11_merkle_manifest(spark, table_of(spark, tmp_path, [])).count() == 0
    assert merkle.build(spark.createDataFrame([], "doc_id long, source string, leaf string")).root() is None


def test_many_parts_and_rounds(spark, monkeypatch):
    """240 ranges, merged five at a time, need four rounds; one key holds a third of all rows."""
    monkeypatch.setattr(merkle, "FAN", 5)
    n = 480
    rows = [(i if i % 3 else 5, ["hot", "hot", "hot", "b", f"s{i}"][i % 5], h(str(i if i % 3 else 0))) for i in range(n)]
    m = merkle.build(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), part_rows=2)
    assert m.leaves.agg(F.max("part")).first()[0] > merkle.FAN**3
    assert m.leaves.groupBy("part").count().agg(F.max("count")).first()[0] < n / 20
    by = collections.defaultdict(list)
    for d, s, x in rows:
        by[s].append((d, x))
    trees = [plain([x for _, x in sorted(by[s])])[0] for s in sorted(by)]
    assert m.root() == plain(trees)[0]
    got = merkle.prove(m, siblings=True)
    assert got.where("verified AND folded_root = root").count() == n
    assert got.where(F.sha2(F.array_join("siblings", ""), 256) != F.col("proof_sha256")).count() == 0


def test_fragments_are_a_monoid():
    """Any dealing of the leaves, merged in any order and grouping, gives the same nodes."""
    rng = np.random.default_rng(3)
    leaves = {0: 10, 1: 1, 2: 28, merkle.TOP: 3}
    for arity in (2, 3, 4):
        shape = merkle.Shape(leaves, arity)
        keys = {shape.name(t, 0, i): h(f"{t} {i}").encode() for t in range(3) for i in range(leaves[t])}
        want, _ = merkle.merge({}, keys, shape)
        assert list(want) == [(merkle.TOP, len(shape.widths(merkle.TOP)) - 1, 0)]
        for _ in range(20):
            deal = rng.integers(0, 6, len(keys))
            parts = [merkle.merge({}, {k: x for (k, x), d in zip(keys.items(), deal) if d == p}, shape)[0] for p in range(6)]
            while len(parts) > 1:
                i = int(rng.integers(len(parts) - 1))
                parts[i : i + 2] = [merkle.merge(parts[i + 1], parts[i], shape)[0]]
            assert parts[0] == want


def test_climb_is_merge():
    for n in (1, 2, 3, 9, 10, 26, 27, 28, 82):
        shape = merkle.Shape({0: n, merkle.TOP: 1}, 3)
        leaves = [h(str(i)).encode() for i in range(n)]
        for a in range(n):
            for b in range(a + 1, n + 1, 5):
                want, _ = merkle.merge({}, {shape.name(0, 0, i): leaves[i] for i in range(a, b)}, shape)
                assert merkle.climb(0, a, leaves[a:b], shape)[1] == want
