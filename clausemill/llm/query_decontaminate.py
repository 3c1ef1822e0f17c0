"""Benchmark decontamination of the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.decontaminate import find_matches


def op8_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = F.transform("item_ids", lambda i: i.cast("string"))
    # the longest verbatim match, the first of them in the document
    longest = F.array_max(F.transform("matches", lambda m: F.struct(m["n_words"].alias("words"), (-m["doc_start"]).alias("back"))))
    return (
        find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_matches=True)
        .select("doc_id", "n_words", "n_hit", F.sort_array(items).alias("items"), longest.alias("longest"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.coalesce("longest.words", F.lit(0)).cast("long").alias("longest_words"),
            (-F.col("longest.back")).alias("longest_start"),
        )
    )


QUERIES = {"op8_decontamination": op8_decontamination}
