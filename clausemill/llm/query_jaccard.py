"""The n-gram Jaccard join of the whole documents table with itself."""

from __future__ import annotations

from clausemill.llm.jaccard import near_duplicates


def op7_ngram_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
