"""Quality rules: decision lists learned from labelled statistics of texts.

Sequential covering: grow a conjunction of thresholds by information gain, prune it on held-back rows, take out what it
covers, go on while the next rule holds good on the held-back rows. The list becomes one ordered Spark conditional.

Cases: null or empty text has zero statistics and fails the base rule; labels that are null or without a document are
left out; repeated rows count once each; without labels, or with one class only, the list is empty and keeps whatever
passes the base rule; extra columns are ignored. Only fitting is bounded: at most about `most_rows` labelled rows, drawn
by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .words import SPACE, mixed, per_text, raw, slices, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(h: np.ndarray, off: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of `width` that the text holds twice or more."""
    n = len(h)
    if n < width:
        return np.zeros(len(off) - 1, np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = text[: n - width + 1] == text[width - 1 :]
    from .words import window_hashes

    at = np.flatnonzero(inside)
    keys = window_hashes(h, width)[at] ^ mixed(text[at])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return per_text(np.cumsum(edge[:-1]) > 0, off)


def duplicate_lines(texts) -> np.ndarray:
    """For each text, its \\n-split lines with a word that equal an earlier line."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    if not len(flat):
        return np.zeros(len(off) - 1, np.int64)
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(filled)
    keys = text[at] * (ids.max() + 1) + ids[at]
    first = np.zeros(len(at), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    again = np.zeros(len(flat), bool)
    again[at[~first]] = True
    return per_text(again, off)


def text_stats(texts) -> dict[str, np.ndarray]:
    data, off = raw(texts)
    space = SPACE[data]
    flat, woff = words(texts, lower=False)
    return {
        "n_words": np.diff(woff),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~space, off),
        "n_symbols": per_text(SYMBOLS[data], off),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeated_words(word_hashes(flat), woff),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS) for every row of docs (doc_id, text)."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in text_stats(b.column("text")).items()}})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in STATS))


# --- the learner -------------------------------------------------------------------------------------------------
#: Features: a statistic, or a ratio of two (0 where the divisor is 0).
FEATURES = {
    "n_words": ("n_words", None),
    "word_chars": ("word_chars", None),
    "n_symbols": ("n_symbols", None),
    "n_dup_lines": ("n_dup_lines", None),
    "n_repeat_words": ("n_repeat_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def on(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold


def feature_matrix(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (a, b) in FEATURES.items():
        x = np.asarray(stats[a], float)
        if b:
            y = np.asarray(stats[b], float)
            x = np.divide(x, y, out=np.zeros_like(x), where=y > 0)
        out[name] = x
    return out


def _covered(rule, x, n):
    hit = np.ones(n, bool)
    for t in rule:
        hit &= t.on(x[t.feature])
    return hit


def _grow(x, bad, most_tests, most_cuts):
    """A conjunction that covers bad rows, by the gain p * (log2 p/(p+n) - log2 P/(P+N))."""
    rule, hit = [], np.ones(len(bad), bool)
    while len(rule) < most_tests and (~bad[hit]).any():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v, y = values[hit], bad[hit]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, most_cuts)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, v, "left")  # v <= cuts[i] for i >= at
            p = np.cumsum(np.bincount(at[y], minlength=len(cuts) + 1))[: len(cuts)]
            n = np.cumsum(np.bincount(at[~y], minlength=len(cuts) + 1))[: len(cuts)]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Test(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].on(x[best[1].feature])
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3, most_rules: int = 32, most_tests: int = 5, precision: float = 0.75, least: int = 3, most_cuts: int = 129):
    """Ordered rules (conjunctions of Test) for bad rows; whatever none covers is good.

    A rule stays if at least `least` held-back rows fall under it and a share of `precision` of them is bad; the list ends before
    the first rule that does not.
    """
    n = len(bad)
    held = np.random.default_rng(seed).random(n) < 1 / 3
    left, rules = np.ones(n, bool), []
    while len(rules) < most_rules and bad[left & ~held].any():
        g, h = left & ~held, left & held
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], most_tests, most_cuts)
        if not rule:
            break
        xh = {k: v[h] for k, v in x.items()}

        def worth(r):
            hit = _covered(r, xh, int(h.sum()))
            p, m = bad[h][hit].sum(), (~bad[h][hit]).sum()
            return (p - m) / (p + m) if p + m else -1.0

        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = _covered(rule, x, n) & left
        p, m = (bad & hit & held).sum(), (~bad & hit & held).sum()
        if p + m < least or p < precision * (p + m):
            break
        rules.append(tuple(rule))
        left &= ~hit
    return rules


def condition(rules, good=True):
    """The ordered Spark conditional of a list: not good for the first rule that holds, else good."""

    def column(name):
        a, b = FEATURES[name]
        return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    out = None
    for rule in rules:
        hit = F.lit(True)
        for t in rule:
            hit = hit & ((column(t.feature) > t.threshold) if t.above else (column(t.feature) <= t.threshold))
        out = F.when(hit, F.lit(not good)) if out is None else out.when(hit, F.lit(not good))
    return F.lit(good) if out is None else out.otherwise(F.lit(good))


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = 20_000):
    """Rules from labels (doc_id, quality: 1 good, 0 bad), about most_rows of them by hash of doc_id; at most twice as many rows
    come to the driver, even where doc_ids repeat."""
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    share = min(1.0, most_rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stats.join(labels, "doc_id").orderBy("doc_id", *STATS, "quality").limit(2 * most_rows).toPandas()
    if not len(rows) or rows.quality.nunique() < 2:
        return []
    return learn(feature_matrix({k: rows[k].to_numpy() for k in STATS}), (rows.quality == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """(doc_id, STATS, base_failed, kept)."""
    small_batches(docs.sparkSession)
    stats = materialize(statistics(docs), "quality-stats")
    rules = fit(stats, labels, most_rows)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & condition(rules))


def op1_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
