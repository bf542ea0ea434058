"""near_duplicates where one document is near to hundreds that are not near to each other, against all pairs."""

import random

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_hot_leader_keeps_one_row(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for k in range(150):  # one word changed: near the first, far from most others
        t = base[:]
        t[rng.randrange(5, 55)] = f"x{k}"
        texts.append(" ".join(t))
    texts += [" ".join(f"z{k}_{i}" for i in range(30)) for k in range(20)] + ["", None, "two words"]
    rng.shuffle(texts)
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                alike += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert 150 <= alike < 151 * 150 / 4  # far from all pairs
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i in range(len(texts)) if find(i) == i)
