"""Packing of the whole documents table."""

from __future__ import annotations

from clausemill.llm.packing import pack_documents


def op9_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_packing": op9_packing}
