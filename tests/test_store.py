"""The store at size and under several writers: artifacts in parts, the cache of artifacts, claimed versions."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from scanlake.sources import store

FEATURE = "ord int, region_id string, feature_id string, feature_json string, created_at string"


def test_parts_hold_all_rows_in_order(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rng = random.Random(1)
    rows = [("big", i, rng.choice(["", "x", "ü\n\"q\"", None]), rng.random()) for i in range(3000)] + [("small", 5, "only", 1.0)] + [("long", i, "y" * (5000 if i % 3 else 3), 0.5) for i in range(9)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, i int, t string, v double")
    s.write_parts("points", df, "k", ["i"], part_bytes=2000, piece_rows=700)
    parts = s.read("points_parts")
    assert parts.where("bytes > 2000 AND rows > 1").count() == 0 and parts.where("artifact_key = 'big'").count() > 30
    for k in ("big", "small", "long"):
        want = [{"i": i, "t": t, "v": v} for a, i, t, v in rows if a == k]
        assert list(s.read_parts("points", k)) == want
        for first, n in ((0, 1), (len(want) // 2, 40), (len(want) - 1, 5), (len(want), 1)):
            assert list(s.read_parts("points", k, first, n)) == want[first : first + n]
        m = s.read("points_manifest", artifact_key=k).first()
        assert m["rows"] == len(want) and m["parts"] == parts.where(F.col("artifact_key") == k).count()
    s.write_parts("none", df.limit(0), "k", ["i"])
    assert list(s.read_parts("none", "big")) == [] and s.read("none_manifest").count() == 0


def test_parts_of_equal_rows(spark, tmp_path):
    """Rows that nothing tells apart are all kept, over several ranges."""
    s = store.Store(spark, str(tmp_path / "s"))
    s.write_parts("t", spark.createDataFrame([("a", 1)] * 500, "k string, v int"), "k", ["v"], part_bytes=200, piece_rows=100)
    assert list(s.read_parts("t", "a")) == [{"v": 1}] * 500


def test_cache_hits_evictions_and_new_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CACHED", 3)
    s = store.Store(spark, str(tmp_path / "s"))
    s.write("t", spark.createDataFrame([(k, i) for i, k in enumerate("abcde")], "k string, v int"), "k")
    assert s.cached("t", k="b").first()["v"] == 1 and s.cached("t", k="b") is s.cached("t", k="b") and s.misses == 1
    first = s.cached("t", k="a")
    for k in "cd":
        s.cached("t", k=k)
    assert s.misses == 4 and len(s.kept) == 3 and first.is_cached
    s.cached("t", k="a")  # the least recently read goes, not the oldest
    s.cached("t", k="e")
    assert [dict(k[2])["k"] for k in s.kept] == ["d", "a", "e"] and s.misses == 5
    time.sleep(0.05)
    s.write("t", spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert s.cached("t", k="a").first()["v"] == 9 and s.misses == 6 and len(s.kept) == 1 and not first.is_cached


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path / "s"), []

    def write(i):
        try:
            new = spark.createDataFrame([(1, f"r{i}", None, json.dumps({"by": i}), None)], FEATURE)
            store.Store(spark, root).replace_features(new, f"20{i}", keep=True)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    s = store.Store(spark, root)
    assert {r["feature_id"] for r in s.features().collect()} == {f"r{i}" for i in range(4)}
    assert sorted(s._marks("claim")) == sorted(s._marks("done")) == [1, 2, 3, 4]


def test_lost_and_failed_writers(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a", None, "{}", None)], FEATURE)
    assert s.features().count() == 0 and s.replace_features(one, "1") == 1
    with pytest.raises(Exception, match="repeated feature id"):
        s.replace_features(one.unionByName(one), "2")
    assert s._marks("claim") == [1]  # a failed writer gives its number back
    assert store._create(spark, f"{s.root}/saved_features_marks/2.claim") and not store._create(spark, f"{s.root}/saved_features_marks/2.claim")
    assert s.features().first()["updated_at"] == "1"  # what is not whole is not seen
    assert s.replace_features(one, "3", patience=0.3) == 1  # the writer of version 2 is lost
    assert sorted(s._marks("done")) == [1, 3] and s.features().first()["updated_at"] == "3"
