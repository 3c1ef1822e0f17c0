"""Token counts of the whole documents table, before and after a fixed log of edits made from each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.token_tree import EDIT, count_tokens


def edits_of(n, lang, source):
    """An insertion in the middle, a deletion in the first quarter, a replacement near the end, an addition."""
    long = lambda x: F.floor(x).cast("long")
    rows = [
        (long(n / 2), 0, F.concat(F.lit(" [from "), F.coalesce(source, F.lit("")), F.lit("] "))),
        (long(n / 4), 17, F.lit("")),
        (long(n * 0.9), 6, F.coalesce(F.upper(lang), F.lit(""))),
        (n + 100, 0, F.lit("\nEnd of document.")),
    ]
    return F.array(*[F.struct(a.cast("long").alias("start"), F.lit(b).cast("long").alias("length"), c.alias("replacement")) for a, b, c in rows]).cast(f"array<{EDIT}>")


def op1_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.length(F.coalesce("text", F.lit("")))
    return count_tokens(docs.select("doc_id", "text", edits_of(n, F.col("lang"), F.col("source")).alias("edits")))


QUERIES = {"op1_token_counts": op1_token_counts}
