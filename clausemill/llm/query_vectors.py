"""Near duplicates of the whole embeddings table."""

from __future__ import annotations

from clausemill.llm.pca_tiles import near_vectors


def op13_embedding_neardup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_neardup": op13_embedding_neardup}
