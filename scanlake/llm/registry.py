"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import html, langid, lm, merkle, mixing, negatives, ngram_join, oracles, packing, quality, secrets, tokens, topk, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_packing": packing.op2_packing,
        "op3_topk": topk.op3_topk,
        "op4_html": html.op4_html,
        "op5_lm": lm.op5_lm,
        "op6_mixing": mixing.op6_mixing,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_secrets": secrets.op8_secrets,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_language": langid.op10_language,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_warc": warc.op12_warc,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {"op3_topk": oracles.TOPK, "op7_ngram_join": oracles.NGRAM_JOIN, "op8_secrets": oracles.secrets_sql(), "op11_merkle_manifest": oracles.MERKLE, "op12_warc": oracles.WARC, "op13_hard_negatives": oracles.NEGATIVES}
