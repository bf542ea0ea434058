"""Candidate pairs of the n-gram join: those that meet once by chance go early, representatives need no shuffle of texts."""

import random

from scanlake.llm import ngram_join as J


def test_pairs_that_meet_once_go_early(spark, monkeypatch):
    """Texts of their own words that share one sentence in pairs, and near copies: only the latter reach the comparison."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    texts = [[word() for _ in range(80)] for _ in range(60)]
    for i in range(0, 40, 2):
        texts[i + 1][10:13] = texts[i][10:13]  # one shingle in common
    texts += [t[:-1] + [word()] for t in texts[50:]]  # near copies of the last ten
    seen, write = {}, J.materialize

    def kept(df, name):
        out = write(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(J, "materialize", kept)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.link(df).collect()}
    assert got == {i: i if i < 60 else i - 10 for i in range(70)}
    assert seen["join-pairs"] == 10


def test_representatives_either_way(spark):
    """The same rows whether representatives are broadcast, or the others, or neither."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4, 4)] + [(None, "x")], "doc_id long, text string")
    rows = docs.select("doc_id")
    classes = spark.createDataFrame([(1,), (3,), (4,)], "rep long")
    want = [(1, "t1"), (3, "t3"), (4, "t4"), (4, "t4")]
    for most in (1 << 20, 16, 0):
        assert sorted(map(tuple, J.representatives(docs, rows, J.materialize(classes, "c"), most).collect())) == want
    plan = J.representatives(docs, rows, J.materialize(classes, "c"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_passages_of_unlike_texts_make_no_list(spark, monkeypatch):
    """A passage that unlike texts share, too rare for a task to find it frequent, leaves their prefixes: no list of theirs is
    compared member by member, and the links are all found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    passages = [[word() for _ in range(20)] for _ in range(2)]
    texts = [[word() for _ in range(300)] + passages[i % 2] for i in range(40)]
    texts += [t[:-1] + [word()] for t in texts[30:]]  # near copies of the last ten
    seen, write = {}, J.materialize

    def kept(df, name):
        out = write(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(J, "materialize", kept)
    monkeypatch.setattr(J, "LEAST_FREQUENT", 1 << 40)  # as where a task's part of a large table holds each passage once
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.link(df, short=4).collect()}
    assert got == {i: i if i < 40 else i - 10 for i in range(50)}
    assert seen["join-groups"] == 0 and seen["join-pairs"] == 10
