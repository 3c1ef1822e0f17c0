"""Line dedup of the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.line_dedup import dedup_lines


def op2_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_deleted", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
