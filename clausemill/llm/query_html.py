"""Main text of the whole pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.html_crf import extract


def op6_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
