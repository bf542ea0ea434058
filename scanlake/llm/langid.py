"""Language of texts by a linear-chain conditional random field over words.

Each word has weights for its affixes and character n-grams (byte n-grams of ^word$, hashed) and, if the lexicon of the
training sample holds it, one for the word itself. Labels of neighbours are tied by learned transitions. Training texts
are cut and spliced into code-switched sequences, as whole texts never change their label. A text's language is the one
with most expected words under forward-backward over all its words; its score is that share of the words. Besides, a text is
as familiar as the share of its words' n-grams (of words with a letter) that the training sample holds: near 1 for texts of
the learned languages, about 0.7 for random Latin letters, less for other scripts.

Long texts are cut into segments only to compute: each segment's transfer matrix is found on its own, the matrices are
chained, and the marginals are those of the whole text.

Cases: null texts and texts without a letter are `und` with score 0; so are all texts if nothing can be learned; null
languages are not learned from; repeated rows and ids count once each; an empty table gives an empty table; extra
columns are ignored. Fitting alone is bounded: about `per_language` texts of each language, drawn by hash among those of
at most `most_chars` characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, small_side, table
from .words import mixed, raw, slices, word_hashes, words

BUCKETS, LONGEST = 1 << 16, 4
SEGMENT = 128
FOUND = ("lang_pred", "score", "familiar")


def word_features(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets of each word's): byte n-grams of ^word$ for n up to LONGEST, the marked ones being its affixes."""
    data, off = raw(pc.utf8_lower(values))
    n = np.diff(off)
    m = n + 2
    start = np.concatenate([[0], np.cumsum(m)])
    flat = np.empty(start[-1], np.uint64)
    flat[start[:-1]], flat[start[1:] - 1] = 1, 2
    flat[np.arange(len(data)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = data.astype(np.uint64) + np.uint64(3)
    word = np.repeat(np.arange(len(n)), m)
    ends = start[1:][word]
    at = np.arange(len(flat))
    keys, owner, h = [], [], np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            at = at[: len(flat) - k + 1]
            h = h[: len(at)] * np.uint64(0x100000001B3) + flat[k - 1 :]
            ok = at + k <= ends[: len(at)]
            keys.append(mixed(h[ok] + np.uint64(k << 56)) % np.uint64(BUCKETS))
            owner.append(word[: len(at)][ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


class Model:
    def __init__(self, labels: list[str], lexicon: np.ndarray):
        self.labels, self.lexicon = labels, lexicon  # lexicon: sorted word hashes
        self.w = np.zeros((BUCKETS + len(lexicon), len(labels)), np.float32)
        self.t = np.zeros((len(labels), len(labels)), np.float32)
        self.seen = np.zeros(BUCKETS, bool)  # n-grams of the training sample

    def features(self, values: pa.Array, found=None) -> tuple[np.ndarray, np.ndarray]:
        """(weights' rows, offsets of each word's): its n-grams (found, if given) and, if the lexicon has it, the word itself."""
        keys, off = found or word_features(values)
        if not len(self.lexicon):
            return keys, off
        h = word_hashes(pc.utf8_lower(values))
        i = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        known = np.flatnonzero(self.lexicon[i] == h)
        return np.insert(keys, off[known + 1], BUCKETS + i[known]), off + np.concatenate([[0], np.cumsum(np.bincount(known, minlength=len(values)))])

    def emissions(self, values: pa.Array, step: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
        """(summed weights of each word, share of its n-grams that are known; -1 without a letter), `step` words at a time."""
        out, familiar = np.zeros((len(values), len(self.labels)), np.float32), np.zeros(len(values), np.float32)
        for lo in range(0, len(values), step):
            part = values.slice(lo, step)
            found = word_features(part)
            familiar[lo : lo + step] = np.add.reduceat(self.seen[found[0]].view(np.uint8), found[1][:-1], dtype=np.float32) / np.diff(found[1])
            keys, off = self.features(part, found)
            out[lo : lo + step] = np.add.reduceat(self.w[keys], off[:-1], axis=0)
        return out, np.where(pc.match_substring_regex(values, r"\p{L}").to_numpy(zero_copy_only=False), familiar, np.float32(-1))

    def shares(self, e: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Expected words of each label in each text; e: emissions of all words, off: offsets of the texts' words."""
        n, k = len(off) - 1, len(self.labels)
        out = np.zeros((n, k))
        if not len(e):
            return out
        size = np.diff(off)
        parts = -(-size // SEGMENT)
        text = np.repeat(np.arange(n), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = off[text] + nth * SEGMENT
        length = np.minimum(SEGMENT, off[text + 1] - begin)
        order = np.argsort(-length, kind="stable")
        text, nth, begin, length = text[order], nth[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(length[0]), "left")  # segments longer than t
        x = np.exp(e - e.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-20)
        t = np.exp(self.t - self.t.max()).astype(np.float32)
        m = np.tile(np.eye(k, dtype=np.float32), (len(text), 1, 1))
        for s, a in enumerate(active):
            y = (m[:a] @ t) * x[begin[:a] + s, None, :]
            m[:a] = y / y.max((1, 2), keepdims=True)
        # chain the segments of each text
        front, back = np.ones((len(text), k), np.float32), np.ones((len(text), k), np.float32)
        at = {}
        by_nth = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[by_nth], np.arange(nth.max() + 2))
        groups = [by_nth[cuts[i] : cuts[i + 1]] for i in range(nth.max() + 1)]
        v = np.ones((n, k), np.float32)
        for g in groups:
            front[g] = v[text[g]]
            y = np.einsum("ij,ijk->ik", front[g], m[g])
            v[text[g]] = y / y.max(1, keepdims=True)
        v[:] = 1
        for g in reversed(groups):
            back[g] = v[text[g]]
            y = np.einsum("ijk,ik->ij", m[g], back[g])
            v[text[g]] = y / y.max(1, keepdims=True)
        alpha = np.zeros((len(active), len(text), k), np.float32)
        f = front
        for s, a in enumerate(active):
            y = (f[:a] @ t) * x[begin[:a] + s]
            f[:a] = y / y.max(1, keepdims=True)
            alpha[s, :a] = f[:a]
        got = np.zeros((len(text), k))
        for s in range(len(active) - 1, -1, -1):
            a = active[s]
            y = alpha[s, :a] * back[:a]
            got[:a] += y / y.sum(1, keepdims=True)
            z = (x[begin[:a] + s] * back[:a]) @ t.T
            back[:a] = z / z.max(1, keepdims=True)
        np.add.at(out, text, got)
        return out


def spliced(texts: list[np.ndarray], labels: np.ndarray, rng, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, labels), count x length: a third of one text each, the others of runs of several texts."""
    ids, ys = np.zeros((count, length), np.int64), np.zeros((count, length), np.int64)
    by = [np.flatnonzero(labels == y) for y in range(labels.max() + 1)]
    for i in range(count):
        at = 0
        while at < length:
            y = int(rng.integers(len(by)))
            d = texts[by[y][rng.integers(len(by[y]))]]
            n = length - at if i % 3 == 0 else min(length - at, int(rng.integers(3, 30)))
            b = int(rng.integers(max(1, len(d) - n + 1)))
            run = d[b : b + n]
            ids[i, at : at + len(run)], ys[i, at : at + len(run)] = run, y
            at += len(run)
    return ids, ys


def train(texts: list[str], langs: list[str], seed: int = 5, sequences: int = 6000, length: int = 48, batch: int = 250, epochs: int = 2, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Fits a Model by AdaGrad on the conditional log-likelihood of spliced sequences."""
    labels = sorted(set(langs))
    flat, off = words(pa.array(texts, pa.large_string()), lower=False)
    d = flat.dictionary_encode()
    ids = d.indices.to_numpy().astype(np.int64)
    keep = [i for i in range(len(texts)) if off[i + 1] > off[i]]
    y = np.array([labels.index(langs[i]) for i in keep])
    labels = [x for i, x in enumerate(labels) if (y == i).any()]
    y = np.array([labels.index(langs[i]) for i in keep])
    hashes = word_hashes(pc.utf8_lower(d.dictionary))
    seen = np.bincount(ids, minlength=len(hashes))
    known, inverse = np.unique(hashes, return_inverse=True)
    model = Model(labels, known[np.bincount(inverse, weights=seen) >= 3])
    for lo in range(0, len(d.dictionary), 1 << 14):
        model.seen[word_features(d.dictionary.slice(lo, 1 << 14))[0]] = True
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    xs, ys = spliced([ids[off[i] : off[i + 1]] for i in keep], y, rng, length, sequences)
    used, xs_at = np.unique(xs, return_inverse=True)
    xs = xs_at.reshape(xs.shape)
    keys, koff = model.features(d.dictionary.take(pa.array(used)))
    k, square_w, square_t = len(labels), np.full_like(model.w, 1e-4), np.full_like(model.t, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(sequences)
        for lo in range(0, sequences, batch):
            b, gold = xs[order[lo : lo + batch]], ys[order[lo : lo + batch]]
            used, at = np.unique(b, return_inverse=True)
            n = koff[used + 1] - koff[used]
            own = np.repeat(np.arange(len(used)), n)
            rows = keys[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + koff[used][own]]
            e = np.add.reduceat(model.w[rows], np.cumsum(n) - n, axis=0)[at.reshape(b.shape)]
            x, t = np.exp(e - e.max(2, keepdims=True)), np.exp(model.t)
            alpha, beta = np.zeros(x.shape), np.ones(x.shape)
            v = np.ones((len(b), k))
            for s in range(length):
                v = (v @ t) * x[:, s]
                v /= v.sum(1, keepdims=True)
                alpha[:, s] = v
            grad_t = np.zeros((k, k))
            np.add.at(grad_t, (gold[:, :-1], gold[:, 1:]), 1.0)
            for s in range(length - 1, 0, -1):
                z = x[:, s] * beta[:, s]
                pair = alpha[:, s - 1, :, None] * t * z[:, None, :]
                grad_t -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                v = z @ t.T
                beta[:, s - 1] = v / v.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            post = -post
            np.put_along_axis(post, gold[:, :, None], np.take_along_axis(post, gold[:, :, None], 2) + 1, 2)
            at = at.ravel()
            words_g = np.stack([np.bincount(at, weights=post[:, :, j].ravel(), minlength=len(used)) for j in range(k)], 1)
            touched, back = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(back, weights=words_g[own, j], minlength=len(touched)) for j in range(k)], 1) / batch
            g -= decay * model.w[touched]
            square_w[touched] += g * g
            model.w[touched] += rate * g / np.sqrt(square_w[touched])
            g = grad_t / batch
            square_t += g * g
            model.t += (rate * g / np.sqrt(square_t)).astype(np.float32)
    return model


def fit(docs: DataFrame, per_language: int = 400, most_chars: int = 20_000, seed: int = 11, languages: int = 256) -> Model | None:
    """A Model from docs (doc_id, text, lang); the sample that comes to the driver is bounded by its parameters: about per_language texts of each of the
    `languages` most frequent languages (ties to the first by name), twice as many at most where rows repeat."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") <= most_chars) & F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = materialize(counts.select("lang", (F.least(F.lit(1.0), per_language / F.col("n")) * (1 << 24)).cast("long").alias("_cut")), "language-counts")
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 24))
    drawn = rows.withColumn("_place", place).join(small_side(counts), "lang").where(F.col("_place") < F.col("_cut"))
    # copies of a row have one place and are drawn together: the first so many of a language stay
    drawn = drawn.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text"))).where(F.col("_at") <= 2 * per_language)
    got = sorted((r["lang"], r["text"]) for r in drawn.select("text", "lang").collect())
    return train([t for _, t in got], [x for x, _ in got]) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and familiar (0 to 1) for every row, by its text alone."""

    def one(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        fine = pc.fill_null(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        lang, score, familiar = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
        at = np.flatnonzero(fine)
        if model is not None and len(at):
            flat, off = words(texts.take(pa.array(at)), lower=False)
            d = flat.dictionary_encode()
            ids = d.indices.to_numpy()
            weights, known = model.emissions(d.dictionary)
            got = model.shares(weights[ids], off)
            f, of = known[ids], np.repeat(np.arange(len(at)), np.diff(off))
            familiar[at] = np.bincount(of[f >= 0], f[f >= 0], len(at)) / np.maximum(1, np.bincount(of[f >= 0], minlength=len(at)))
            got /= got.sum(1, keepdims=True)
            lang[at] = np.array(model.labels, object)[got.argmax(1)]
            score[at] = np.minimum(1.0, got.max(1))
        return lang.tolist(), score, np.minimum(1.0, familiar)

    def run(batches):
        for b in slices(batches, most_bytes=4 << 20):
            lang, score, familiar = one(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(familiar, pa.float64())], [*b.schema.names, *FOUND])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    small_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in FOUND])
    kinds = [StructField(c, StringType() if c == "lang_pred" else DoubleType()) for c in FOUND]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *kinds]))


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
