"""Splits of a labelled table: stratified, by group, by source; leakage checks.

Membership follows a seeded MD5 of the row id, so it does not depend on partitioning, a lost task gives the
same rows again, and any other engine can repeat it. Strata are cut by rank within the stratum, so proportions hold to
one row; rows that share an id are on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators.relational import running_sum

RARE = "__rare__"


def seeded(seed: int, key: Column) -> Column:
    """The order of a key under a seed: the MD5 of ``seed:key`` in hexadecimal; a null key counts as the empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def stratum(primary: Column, harm: Column) -> Column:
    return F.concat(F.coalesce(primary, F.lit("none")), F.lit("__harm"), F.coalesce(harm, F.lit(-1)).cast("string"))


def collapse_rare(df: DataFrame, key: str, least: int) -> DataFrame:
    """Strata of fewer than ``least`` rows become one; counted by an aggregate, so a large stratum is no single task."""
    small = df.groupBy(key).count().where(F.col("count") < least).select(key, F.lit(True).alias("__small"))
    return df.join(small, key, "left").withColumn(key, F.when(F.col("__small"), RARE).otherwise(F.col(key))).drop("__small")


def stratified_split(df: DataFrame, key: str, row_id: str = "row_id", seed: int = 42, validation: float = 0.1, test: float = 0.1, least: int = 5) -> DataFrame:
    """Adds ``split``: test, validation or train, in the given shares of each stratum; rare strata are cut together."""
    held = collapse_rare(df.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("none"))), "__key", least)
    held = held.withColumn("__at", F.struct(seeded(seed, F.col(row_id)).alias("o"), F.col(row_id).alias("id")))
    # ranks over ranges of (stratum, hash, id) alone: no stratum is one task, and no other column travels
    ids = held.select("__key", F.col("__at.o").alias("o"), F.col("__at.id").alias("id"))
    ranked = running_sum(ids, F.lit(1).cast("long"), "n", ["o", "id"], ["__key"]).join(ids.groupBy("__key").agg(F.count("*").alias("of")), "__key")
    place = (F.col("n") - 0.5) / F.col("of")
    last = lambda share: F.max(F.when(place < share, F.struct("o", "id")))
    cuts = ranked.groupBy("__key").agg(last(test).alias("__test"), last(test + validation).alias("__validation"))
    upto = lambda c: F.coalesce(F.col("__at") <= F.col(c), F.lit(False))
    split = F.when(upto("__test"), "test").when(upto("__validation"), "validation").otherwise("train")
    return held.join(cuts, "__key").withColumn("split", split).select(*df.columns, "split")


def group_split(df: DataFrame, group: str, seed: int = 42, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds ``split`` by a hash of the group, so that a group is never on two sides; no shuffle."""
    place = F.conv(F.substring(seeded(seed, F.col(group)), 1, 8), 16, 10).cast("long") / 2**32
    return df.withColumn("split", F.when(place < test, "test").when(place < test + validation, "validation").otherwise("train"))


def straddling(df: DataFrame, group: str) -> DataFrame:
    """Groups with rows in more than one split: must give no row."""
    return df.groupBy(group).agg(F.min("split").alias("first"), F.max("split").alias("last")).where("first != last")


def leakage(df: DataFrame, text: str) -> DataFrame:
    """Texts in more than one split, with the splits: must give no row."""
    return straddling(df, text).withColumnRenamed("first", "split_a").withColumnRenamed("last", "split_b")


def overlap_counts(df: DataFrame, text: str) -> DataFrame:
    """For each pair of splits how many distinct texts are in both."""
    sets = df.groupBy(text).agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b"))))))
    return sets.where(F.size("s") > 1).select(pairs.alias("p")).groupBy("p.split_a", "p.split_b").count()


def hold_out(df: DataFrame, source: str, sources: str = "sources") -> DataFrame:
    """Rows of a source leave train and validation; only its rows stay in test."""
    own = F.array_contains(F.col(sources), source)
    return df.where(F.when(F.col("split") == "test", own).otherwise(~own))


def assignment(df: DataFrame, text: str, row_id: str = "row_id") -> DataFrame:
    """The split to persist: row id, split and the MD5 of the text to check it by; a null text counts as the empty one."""
    return df.select(F.col(row_id).alias("row_id"), "split", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))


def check_assignment(df: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """One row of counts: rows without a split, splits without a row, and texts that changed; all must be 0."""
    now = df.select("row_id", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("now"))
    both = now.join(stored, "row_id", "full")
    return both.agg(
        F.count_if(F.col("split").isNull()).alias("without_split"),
        F.count_if(F.col("now").isNull()).alias("without_row"),
        F.count_if(F.col("now") != F.col("text_hash")).alias("changed"),
    )


def stratified_sample(df: DataFrame, klass: str, size: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """One row of every class, then others up to ``size``, by a seeded hash. A sampling operator: its limit is its purpose."""
    at = F.struct(seeded(seed, F.col(row_id)).alias("o"), F.col(row_id).alias("id"))
    told = df.withColumn("__at", at).alias("a")
    firsts = df.groupBy(F.col(klass).alias("__klass")).agg(F.min(at).alias("__first")).alias("f")
    told = told.join(firsts, F.col(f"a.{klass}").eqNullSafe(F.col("f.__klass"))).withColumn("__later", (F.col("__at") != F.col("__first")).cast("int"))
    return told.orderBy("__later", "__at").limit(size).select("a.*").drop("__at")
