"""The training-data pipeline: languages, near duplicates, secrets, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and rereads for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import langid, mixing, ngram_join, packing, secrets
from scanlake.llm.common import materialize, small_side, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No language has so large a share of the words: three or more in about equal parts. Texts of two languages stay.
LEAST_SCORE = 0.36
#: Share of known n-grams under which a text is in none of the learned languages (theirs have 0.93 and more, random letters 0.75 and less).
LEAST_FAMILIAR = 0.8
#: From this share on, the prediction is put in the place of another or missing label.
SURE = 0.9
#: Near duplicates: five-word shingles, Jaccard 0.8 or more.
WIDTH, NUM, DEN = 5, 80, 100


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, those in none of the learned languages (LEAST_FAMILIAR) and those in too many
    (LEAST_SCORE); lang becomes the predicted one where the prediction is sure and lang is null or another.

    The model learns from docs' own labels; with none, only the first rule applies; with one language, lang and texts are
    compared with that one. Rows with null or repeated doc_id are judged one by one.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    found = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("familiar") >= LEAST_FAMILIAR))
    return found.withColumn("lang", F.when(F.col("score") >= SURE, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _own, a number of each row: its doc_id, or one below zero where that is null or repeated."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("doc_id IS NULL OR _n > 1")
    odd = materialize(ids.select(F.col("doc_id").alias("_id")), "pipeline-odd")
    if not odd.limit(1).count():
        return docs.withColumn("_own", F.col("doc_id"))
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    rows = rows.join(small_side(odd.withColumn("_odd", F.lit(True))), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return materialize(rows.select(*docs.columns, F.when(F.col("_odd"), -1 - F.col("_row")).otherwise(F.col("doc_id")).alias("_own")), "pipeline-numbered")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the one with the least number. Rows with null or repeated doc_id have numbers of their own,
    so that they lose nothing but copies. Texts without words link with nothing and stay."""
    rows = numbered(docs.select(*COLUMNS))
    groups = ngram_join.link(rows.select(F.col("_own").alias("doc_id"), "text"), WIDTH, NUM, DEN)
    kept = materialize(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_own")), "pipeline-kept")
    return rows.join(small_side(kept), "_own", "left_semi").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows the text. No document goes."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number (0, 1 or 2); the mix sees one row a
    text, so rows with null or repeated doc_id get numbers of their own. Texts without words go."""
    rows = numbered(docs.select(*COLUMNS))
    taken = mixing.mix(rows.select(F.col("_own").alias("doc_id"), "text", "source"))
    taken = taken.where("size > 0").select(F.col("doc_id").alias("_own"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies")).where("_copies > 0")
    out = rows.join(small_side(materialize(taken, "pipeline-taken")), "_own")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place; null texts are empty, rows are packed one by one whatever their doc_id."""
    return packing.pack(docs)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("secrets", hide_secrets), ("mixing", mix_sources), ("packing", pack)]
#: A learned model decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
