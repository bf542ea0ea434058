"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame operations only.

Sources get integer numbers of blocks by the highest quotients target / (2k - 1); within a source its shards get integer
quotas in the same way; within a shard, documents lie on a line in seeded order and the quota is a run of blocks from a
seeded block on, round the end, after as many whole passes as the quota holds. A document's share is what the passes
and the run cover of it.

Rows that agree in source, doc_id, size and text are counted, then numbered, so that any number of repeats is spread over
shards like other rows. Whatever ranks sources or shards does so in one window up to `MOST_RANKED` rows, and by ranges of
the order with running counts beyond.

Cases: null text has size 0; null source is a source of its own, ordered last; null or repeated doc_id are rows like any
other; an empty table gives an empty table; extra columns are ignored. Reruns agree: all choices are hashes of
(seed, doc_id, size, text, number among equal rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table, word_count

WEIGHTS = (5, 2, 1)
MOST_RANKED = 1 << 20
CHUNK = 1 << 16  # equal rows that one row unfolds to at a time


def placed(df: DataFrame, by: list[str], order: list, name: str, most: int) -> DataFrame:
    """df (materialised) with name: the row's place, from 1, among those of its group by `order`, which must leave no ties.

    More than `most` rows are sorted by ranges over all groups; a row's place is its place in its range and the rows before
    that range, less the rows before its group.
    """
    if df.count() <= most:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
    ranged = materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("_range").count()  # a row per range
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = ranged.join(F.broadcast(counts.select("_range", "_before")), "_range")
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*by, *order)) + F.col("_before"))
    x = materialize(x.drop("_range", "_before"), "mix-placed")
    if not by:
        return x.withColumnRenamed("_at", name)
    first = small_side(materialize(x.groupBy(*by).agg(F.min("_at").alias("_first")), "mix-first"))
    return x.join(first, by).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def sainte_lague(df: DataFrame, by: list[str], weight: str, house: str, order: list[str], seats: str, most: int = MOST_RANKED) -> DataFrame:
    """Adds column seats: `house` seats (one value per group `by`) dealt by the highest quotients weight / (2k - 1).

    Ties go to the first by `order`. Only seats near the rounded quota are ranked: with n members and M seats, the
    k-th quotient that is cut off lies within a factor 1 +- n / 2M of the quota's, so the others are sure either way.
    The ranked rows are at most a few times the members.
    """
    keys = by or ["_one"]
    x = df if by else df.withColumn("_one", F.lit(0))
    w, m = F.col(weight).cast("double"), F.col(house).cast("long")
    total = small_side(materialize(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w")), "mix-totals"))
    near = (
        x.join(total, keys)
        .withColumn("_q", F.when((F.col("_w") > 0) & (m > 0), w * m / F.col("_w")).otherwise(0.0))
        .withColumn("_s", F.floor(F.col("_q") + 0.5).cast("long"))
        .withColumn("_r", F.when(m > 0, F.ceil(F.col("_q") * F.col("_n") / m) + 1).otherwise(0).cast("long"))
        .withColumn("_base", F.greatest(F.lit(0).cast("long"), F.col("_s") - F.col("_r")))
    )
    # _k is the number of seats held before; the seat _k + 1 has the quotient w / (2 _k + 1)
    ranked = near.withColumn(
        "_k", F.explode(F.when((w > 0) & (m > 0), F.sequence(F.col("_base"), F.col("_s") + F.col("_r"))).otherwise(F.array(F.lit(0).cast("long"))))
    )
    ranked = materialize(ranked.withColumn("_quotient", -w / (2 * F.col("_k") + 1)), "mix-quotients")
    held = small_side(materialize(ranked.where(F.col("_k") == F.col("_base")).groupBy(*keys).agg(F.sum("_base").alias("_held")), "mix-held"))
    ranked = placed(ranked, keys, ["_quotient", *order, "_k"], "_rank", most).join(held, keys)
    got = (w > 0) & (m > 0) & (F.col("_rank") <= m - F.col("_held"))
    return ranked.groupBy(*df.columns, "_base").agg(F.sum(F.when(got, 1).otherwise(0)).alias("_got")).select(*df.columns, (F.col("_base") + F.col("_got")).alias(seats))


def targets(sources: DataFrame, share: float, most: float, weights=WEIGHTS, most_ranked: int = MOST_RANKED) -> DataFrame:
    """Adds _turn and target to materialised (source, source_size): share * all sizes by weight, at most `most` * source_size each.

    Sources take the weights in turn by code point. Those that would pass their limit get it and the rest is shared anew,
    until none is above: a few aggregates over the sources, each of two numbers.
    """
    s = placed(sources.withColumn("_none", F.col("source").isNull()), [], ["_none", "source"], "_turn", most_ranked).drop("_none")
    s = s.withColumn("_turn", F.col("_turn") - 1).withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_turn") % len(weights) + 1).cast("int")))
    s = materialize(s.withColumn("_cap", F.col("source_size") * F.lit(float(most))), "mix-turns")
    total = s.agg(F.sum("source_size")).first()[0]
    if total is None:
        return s.withColumn("target", F.col("_cap"))
    level, full = 0.0, None
    while True:  # level: words a unit of weight gets; it only rises, as do the sources that are full
        at = F.lit(level) * F.col("_w") >= F.col("_cap")
        caps, n, w = s.agg(F.coalesce(F.sum(F.when(at, F.col("_cap"))), F.lit(0.0)), F.sum(at.cast("long")), F.coalesce(F.sum(F.when(~at, F.col("_w"))), F.lit(0.0))).first()
        if n == full or not w:
            break
        level, full = (share * total - caps) / w, n
    return s.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if w else F.col("_cap"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 16, shard_words: int = 1 << 20, seed: int = 7, weights=WEIGHTS, most_ranked: int = MOST_RANKED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    block: words of a block; the smaller, the nearer a source comes to its target (within a block for each shard).
    shard_words: words of a shard, a window's partition; hot sources have more shards. most_ranked: see placed().
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_h")).withColumn("_key", key)
    base = materialize(base.groupBy("_key", "source", "doc_id", "size", "_h").agg(F.count(F.lit(1)).alias("_times")), "mix-sizes")
    sources = materialize(base.groupBy("_key", "source").agg(F.sum(F.col("size") * F.col("_times")).alias("source_size")), "mix-found")
    sources = targets(sources, share, most, weights, most_ranked)
    house = round((sources.agg(F.sum("target")).first()[0] or 0.0) / block)
    sources = sainte_lague(sources.drop("source", "_w", "_cap").withColumn("_house", F.lit(house).cast("long")), [], "target", "_house", ["_turn"], "_blocks", most_ranked)
    sources = sources.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = small_side(materialize(sources.select("_key", "source_size", "target", "_blocks", "_shards"), "mix-sources"))
    # equal rows unfold in two steps, a third of all rows may be one row's
    count = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long")))
    rows = base.drop("source").withColumn("_c", count(F.col("_times"), CHUNK)).repartition("_h", "doc_id", "_c")
    rows = rows.withColumn("_i", count(F.least(F.lit(CHUNK), F.col("_times") - F.col("_c") * CHUNK), 1)).withColumn("_i", F.col("_i") + F.col("_c") * CHUNK)
    mark = lambda x: F.xxhash64(F.lit(seed + x), "doc_id", "size", "_h", "_i")
    rows = rows.join(sources, "_key").withColumn("_shard", F.pmod(mark(0), F.col("_shards")))
    rows = rows.select("_key", "doc_id", "size", "_h", "_i", "source_size", "target", "_blocks", "_shard")
    shards = materialize(rows.repartition("_key", "_shard").groupBy("_key", "_shard", "_blocks").agg(F.sum("size").alias("_z")), "mix-shards")
    shards = sainte_lague(shards, ["_key"], "_z", "_blocks", ["_shard"], "_quota", most_ranked)
    shards = materialize(shards.select("_key", "_shard", "_z", "_quota"), "mix-quotas")
    line = Window.partitionBy("_key", "_shard").orderBy(mark(1), "doc_id", "size", "_h", "_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("_key", "_shard").withColumn("_b", F.sum("size").over(line)).withColumn("_a", F.col("_b") - F.col("size"))
    rows = rows.join(small_side(shards), ["_key", "_shard"])
    n = F.greatest(F.lit(1), F.ceil(F.col("_z") / block)).cast("long")
    rows = rows.withColumn("_n", n).withColumn("_k", F.least(F.col("_quota"), (F.col("_n") * F.lit(int(most))).cast("long")))
    rows = rows.withColumn("_o", F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_shard"), F.col("_n"))).withColumn("_run", F.col("_k") % F.col("_n"))
    zero = F.lit(0).cast("long")
    over = lambda lo, hi: F.greatest(zero, F.least(F.col("_b"), hi) - F.greatest(F.col("_a"), lo))
    end = F.col("_o") + F.col("_run")
    taken = F.floor(F.col("_k") / F.col("_n")).cast("long") * F.col("size") + over(F.col("_o") * block, F.least(end * block, F.col("_z"))) + over(zero, F.greatest(zero, end - F.col("_n")) * block)
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
