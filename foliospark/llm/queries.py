"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from foliospark.llm import chat_format, conversation_repair, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality_rules, sentencepiece_sampling, toxicity, url_filter, vector_codes, vector_graph


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_language_id": language_id.op5_language_id,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_sentencepiece": sentencepiece_sampling.op10_sentencepiece,
        "op11_vector_graph": vector_graph.op11_vector_graph,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.SQL,
        "op2_line_dedup": line_dedup.SQL,
        "op6_url_filter": url_filter.SQL,
        "op8_quality_rules": quality_rules.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_conversation_repair": conversation_repair.SQL,
    }
