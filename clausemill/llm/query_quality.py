"""Quality rules over the whole documents table."""

from __future__ import annotations

from clausemill.llm.quality import line_first_quality


def op4_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_first_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op4_quality_rules": op4_quality_rules}
