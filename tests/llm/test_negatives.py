"""Hard negatives against brute force, and the searches by bit planes."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from scanlake.llm import negatives

KINDS = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, positives=5, k=10):
    have = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        have.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, v, label) in enumerate(have):
        if a % 100:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), b, m) for j, (b, w, m) in enumerate(have) if j != i and len(w) == len(v)]
        for p, b, _ in sorted(x for x in s if x[2] == label)[:positives]:
            fine = sorted((x, c) for x, c, m in s if m != label and 30 * -p <= 100 * -x <= 90 * -p)[:k]
            out += [(a, b, r + 1, c, -p, -x) for r, (x, c) in enumerate(fine)]
    return out


def got(spark, rows, tmp_path, **sizes):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, 5, 6) for r in rows], KINDS).repartition(4).write.parquet(path)
    return [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in negatives.op13_hard_negatives(spark, str(tmp_path)).collect()]


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 6).tolist(), int(rng.integers(3))) for i in range(420)]
    rows += [(i, np.round(rng.normal(0, 1, 6)).tolist(), int(rng.integers(3))) for i in range(500, 720)]  # ties
    rows += rows[195:215] + [(100, [0.0] * 6, 1), (200, None, 1), (300, [None] + [1.0] * 5, 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (600, [1.0] * 6, None)]
    rows += [(700, [1.0, 2.0], 0), (701, [1.0, 2.0], 0), (702, [0.5, 1.0], 1), (800, [], 2), (801, [], 2), (802, [], 1)]
    want = brute(rows)
    assert len(want) > 200
    assert collections.Counter(got(spark, rows, tmp_path)) == collections.Counter(want)


def test_blocks_agree(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(0, 1, 16).astype(np.float32).tolist(), 0 if i % 3 else i % 7) for i in range(900)], "vec_id long, embedding array<float>, label int")
    one = negatives.mine(rows, F.col("vec_id") % 30 == 0, block=10_000).collect()
    assert len(one) > 500
    assert collections.Counter(one) == collections.Counter(negatives.mine(rows, F.col("vec_id") % 30 == 0, block=100, anchor_block=7).collect())
    cost = negatives.mine(rows, F.col("vec_id") % 30 == 0, read=True).collect()
    assert len(cost) == 30 and all(r["read"] > 0 for r in cost)


def test_empty(spark, tmp_path):
    assert got(spark, [], tmp_path) == []
    rows = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(rows, F.col("vec_id") == 0).count() == 0  # no positive


def test_planes_search_exactly_and_drop():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 12))
    p, ids, at = negatives.Planes(x), rng.permutation(500), np.arange(500)
    assert (sum(b.astype(int) << j for j, b in enumerate(p.planes)) + p.least == x).all()
    for _ in range(20):
        q = rng.integers(-300, 300, 12)
        s = x @ q
        lo, hi = sorted(rng.integers(-200_000, 200_000, 2).tolist())
        ranges = [negatives.ANY, (lo, hi), (5, 4)]
        found, read = p.search(q, at, ids, ranges, 7)
        for (a, b), (where, score) in zip(ranges, found):
            want = sorted((-s[i], ids[i]) for i in at if a <= s[i] <= b)[:7]
            assert [(-y, ids[i]) for i, y in zip(where, score)] == want
    top, read = p.search(q, at, ids, [negatives.ANY], 7)
    assert read < 0.8 * 500 * p.bits  # candidates go on the way


def test_large_components_stay_exact():
    x = np.array([[2**40, -(2**40) + 1], [2**40 - 1, 5], [-1, 2**39]])
    p = negatives.Planes(x)
    q = np.array([3, -2])
    [(at, score)], _ = p.search(q, np.arange(3), np.arange(3), [negatives.ANY], 3)
    want = {i: int(x[i, 0]) * 3 - int(x[i, 1]) * 2 for i in range(3)}
    assert dict(zip(at.tolist(), score.tolist())) == want
