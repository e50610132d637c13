"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import chat_format, decontaminate, html_text, language_id, line_dedup, mixing, ngram_join, quality_cnn, quality_rules, spelling, token_counts, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_warc": warc.query,
    "op3_line_dedup": line_dedup.query,
    "op4_chat_format": chat_format.query,
    "op5_ngram_join": ngram_join.query,
    "op6_quality_rules": quality_rules.query,
    "op7_quality_cnn": quality_cnn.query,
    "op8_language_id": language_id.query,
    "op9_decontaminate": decontaminate.query,
    "op10_mix_sources": mixing.query,
    "op11_whitening": whitening.query,
    "op12_html_text": html_text.query,
    "op13_spelling_variants": spelling.query,
}

#: Token counts, the classifier, language identification and whitening have no SQL: the first and
#: the last are tested against brute force, the other two on held-out rows.
SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_chat_format": chat_format.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_mix_sources": mixing.SQL,
    "op12_html_text": html_text.SQL,
    "op13_spelling_variants": spelling.SQL,
}
