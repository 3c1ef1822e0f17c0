"""Revisit resolution over captures made from the whole pages table.

Each page is a full response, at a minute given by its id, and is asked for again three hours later. Of these
revisits some carry another entity tag, some only a digest and some no validator; the clock and the cache rule of the answer
are newer, its type and length are not permitted to change.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.warc import resolve_revisits


def captures(pages):
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    digest = F.concat(F.lit("md5:"), F.md5(F.coalesce("html", F.lit(""))))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    none = F.lit(None).cast("string")
    later = at + F.expr("INTERVAL 3 HOURS")
    told = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for p in pairs for x in p])
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("etag"), none.alias("last_modified"), digest.alias("digest"),
        told(("Content-Type", "text/html"), ("Content-Length", F.length("html").cast("string")), ("Date", at.cast("string")), ("ETag", tag), ("Cache-Control", "max-age=60")).alias("headers"),
    )
    kind = F.col("page_id") % 10
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(kind == 0, F.lit('"changed"')).when(kind.isin(1, 2), none).otherwise(tag).alias("etag"), none.alias("last_modified"), F.when(kind != 2, digest).alias("digest"),
        told(("Content-Type", "text/plain"), ("Content-Length", "0"), ("Date", later.cast("string")), ("Cache-Control", "max-age=600")).alias("headers"),
    )
    return response.unionByName(revisit)


def op3_revisits(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    done = resolve_revisits(captures(pages))
    return done.select("record_id", "url_key", "response_id", F.unix_seconds("response_ts").alias("response_s"), "outcome", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("headers"))


QUERIES = {"op3_revisits": op3_revisits}
