"""Queries of the text operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (
    chat, decontaminate, mixing, ngram_join, pii, quality_model, quality_rules, secrets, sharding, spelling, toxicity, url_rules, vector_codes,
)


def queries() -> dict:
    return {
        "op1_template_windows": decontaminate.op1_template_windows,
        "op2_byte_cnn": quality_model.op2_byte_cnn,
        "op3_pii_spans": pii.op3_pii_spans,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_byte_shards": sharding.op5_byte_shards,
        "pipeline": corpus_pipeline.run,
        "op9_secret_forest": secrets.op9_secret_forest,
        "op10_severity": toxicity.op10_severity,
        "op6_chat_repair": chat.op6_chat_repair,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_line_rules": quality_rules.op8_line_rules,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_url_rules": url_rules.op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pii_spans": pii.SQL,
        "op4_mix_sources": mixing.SQL,
        "op5_byte_shards": sharding.SQL,
        "op7_ngram_join": ngram_join.SQL,
        "op8_line_rules": quality_rules.SQL,
        "op11_spelling_variants": spelling.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_url_rules": url_rules.SQL,
    }
