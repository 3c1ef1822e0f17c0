"""Personal data in the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.pii import KINDS, find_personal_data, joined


def _of(kind):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs).select(
        "doc_id",
        *map(_of, KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )


QUERIES = {"op10_pii": op10_pii}
