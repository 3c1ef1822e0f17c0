"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two joins on the node, whose hot side the engine
can split; nothing about the graph but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.store import Store


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    told = links.join(least, "a")
    return told.where("b != m").select("b", "m").toDF("a", "b").union(told.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node that can be reached. No links, no rows."""
    now = store.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    before, round_ = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == before or not seen[0]:
            break
        before, round_ = seen, round_ + 1
        after = store.save(_small_star(_large_star(now)), f"{name}-{round_}")
        store.drop(f"{name}-{round_ - 1}")
        now = after
    return now.select("a", "b").union(now.select("b", "b").distinct()).toDF("node", "root")
