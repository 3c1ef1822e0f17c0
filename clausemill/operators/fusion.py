"""Fusion of differently labelled sources into one masked clause table.

The long form holds one row for each (text, source annotation, topic). The wide form holds one row for each
normalised text, with vectors in the order of the topic table. ``mask = 0`` means unknown: it is kept apart
from the label in every step and is never filled by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taxonomy(topics: DataFrame) -> DataFrame:
    """(topic_index, topic_id, name, ...) from one row with an ordered array ``topics``; the order is the vector index."""
    return topics.select(F.posexplode("topics").alias("topic_index", "t")).select("topic_index", "t.*").withColumnRenamed("id", "topic_id")


def label_rules(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source, native_label, topic_id): override rows replace all defaults of their source and label."""
    kept = defaults.join(overrides.select("source", "native_label").distinct(), ["source", "native_label"], "left_anti")
    return kept.withColumn("rule_kind", F.lit("default")).unionByName(overrides.withColumn("rule_kind", F.lit("override")))


def parse_status(text: Column, score: Column, mapped: Column) -> Column:
    """Tested in this order: empty text, unknown class, unmapped topic; else parsed."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text").when(score.isNull(), "unknown_class").when(~mapped, "unmapped_topic").otherwise("parsed")


def mapped_annotations(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long rows of annotations (source, native_label, text, score) by the rules, and those that do not parse with their status."""
    r = rules.select("source", "native_label", "topic_id", F.lit(True).alias("__mapped"))
    told = rows.join(F.broadcast(r), ["source", "native_label"], "left").withColumn("parse_status", parse_status(F.col("text"), F.col("score"), F.coalesce("__mapped", F.lit(False))))
    told = told.drop("__mapped")
    return told.where("parse_status = 'parsed'"), told.where("parse_status != 'parsed'").drop("topic_id")


def conflicts(long: DataFrame) -> DataFrame:
    """(text, topic) groups with more than one score: scores, sources, rows and the longest raw text, first on ties."""
    longest = F.min_by("raw", F.struct(-F.length("raw"), F.col("pos")))
    grouped = long.groupBy("text", "topic_id").agg(
        F.sort_array(F.collect_set("score")).alias("scores"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.count("*").alias("n_rows"),
        longest.alias("raw"),
    )
    return grouped.where(F.size("scores") > 1)


def coverage(long: DataFrame) -> DataFrame:
    """(source, topic_id) pairs that a source can assert at all."""
    return long.select("source", "topic_id").distinct()


def masks(long: DataFrame, full: DataFrame, narrow: list[str], policy: str = "raw", overrides: DataFrame | None = None) -> DataFrame:
    """(text, topic_id) cells that are observed.

    A text is observed on all topics that a source of it covers; for ``narrow`` sources only on the topics of
    its own labels. Policy ``effective`` takes out of a source's coverage what its override rules never
    assert, given as (source, topic_id); ``raw`` leaves them in.
    """
    if policy not in ("raw", "effective"):
        raise ValueError(f"unknown mask policy: {policy}")
    covered = full
    if policy == "effective" and overrides is not None:
        covered = full.join(overrides.select("source", "topic_id").distinct(), ["source", "topic_id"], "left_anti")
    wide = long.where(~F.col("source").isin(narrow)).select("text", "source").distinct().join(F.broadcast(covered), "source").select("text", "topic_id")
    own = long.where(F.col("source").isin(narrow)).select("text", "topic_id")
    return wide.union(own).distinct()


def cells(long: DataFrame, mask: DataFrame, topics: DataFrame) -> DataFrame:
    """One row for each text and topic: label, mask, least score and conflict flag."""
    scored = long.groupBy("text", "topic_id").agg(F.min("score").alias("score"), (F.countDistinct("score") > 1).alias("conflict"))
    observed = mask.select("text", "topic_id", F.lit(1.0).alias("mask"))
    known = scored.withColumn("label", F.lit(1.0)).join(observed, ["text", "topic_id"], "full")
    texts = long.select("text").distinct()
    grid = texts.crossJoin(F.broadcast(topics.select("topic_index", "topic_id")))
    told = grid.join(known, ["text", "topic_id"], "left")
    return told.select(
        "text",
        "topic_index",
        "topic_id",
        F.coalesce("label", F.lit(0.0)).alias("label"),
        F.coalesce("mask", F.lit(0.0)).alias("mask"),
        "score",
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def wide_table(cell: DataFrame, long: DataFrame, conflict_score: str = "min") -> DataFrame:
    """One row a text: vectors by topic, active and conflicting topics in topic order, harm score and provenance.

    ``conflict_score`` is ``min`` (the most cautious) or ``null``.
    """
    score = F.when(F.col("conflict") & F.lit(conflict_score == "null"), F.lit(None)).otherwise(F.col("score"))
    entry = F.struct("topic_index", "topic_id", "label", "mask", score.alias("score"), "conflict")
    vectors = cell.groupBy("text").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    ids = lambda keep: F.transform(F.filter("v", keep), lambda x: x["topic_id"])
    provenance = long.groupBy("text").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_list(F.struct("source", "topic_id", F.col("score").alias("mapped_score")))).alias("native_annotations"),
        F.min("score").alias("harm_score"),
    )
    return vectors.join(provenance, "text").select(
        "text",
        "sources",
        F.col("v.label").alias("labels_presence"),
        F.col("v.mask").alias("topic_mask"),
        F.col("v.score").alias("scores"),
        F.map_from_entries(F.transform(F.filter("v", lambda x: x["score"].isNotNull()), lambda x: F.struct(x["topic_id"], x["score"]))).alias("topic_scores"),
        ids(lambda x: x["label"] == 1.0).alias("active_topic_ids"),
        ids(lambda x: x["conflict"]).alias("conflict_topic_ids"),
        F.exists("v", lambda x: x["conflict"]).alias("has_score_conflict"),
        "harm_score",
        (F.col("harm_score") + 1).alias("harm_score_class"),
        F.col("harm_score").isNotNull().cast("double").alias("harm_mask"),
        "native_annotations",
    )


def identical_columns(cell: DataFrame) -> DataFrame:
    """Pairs of topics with the same labels and masks on all texts: a guard that must give no row.

    Each topic is reduced to a fingerprint by an aggregate, so only topics, not cells, are compared.
    """
    print_ = cell.groupBy("topic_index").agg(
        F.sum(F.xxhash64("text", "label", "mask").cast("decimal(38,0)")).alias("fingerprint"), F.bit_xor(F.xxhash64("label", "mask", "text")).alias("check")
    )
    a, b = print_.alias("a"), print_.alias("b")
    return a.join(b, F.expr("a.fingerprint = b.fingerprint AND a.check = b.check AND a.topic_index < b.topic_index")).select(F.col("a.topic_index").alias("first"), F.col("b.topic_index").alias("second"))


def source_asserted_mask(long: DataFrame, cell: DataFrame, source: str) -> DataFrame:
    """Cells that one source asserts itself, for scoring on a source held out."""
    own = long.where(F.col("source") == source).select("text", "topic_id").distinct()
    return cell.where("mask = 1.0").join(own, ["text", "topic_id"], "left_semi")


def source_composition(long: DataFrame, cell: DataFrame) -> DataFrame:
    """(topic_id, source, n_texts): distinct texts a source annotates, where the cell is observed."""
    seen = cell.where("mask = 1.0").select("text", "topic_id")
    return long.join(seen, ["text", "topic_id"], "left_semi").groupBy("topic_id", "source").agg(F.countDistinct("text").alias("n_texts"))


def document_id(annotations: Column, services: Column, row: Column, qualifying: list[str]) -> Column:
    """``dataset:document`` of the first qualifying annotation with a colon in its id; else the service; else ``unknown:row``."""
    first = F.get(F.filter(annotations, lambda a: a["source_dataset"].isin(qualifying) & F.contains(a["source_id"], F.lit(":"))), 0)
    own = F.when(first.isNotNull(), F.concat_ws(":", first["source_dataset"], F.substring_index(first["source_id"], ":", 1)))
    return F.coalesce(own, services, F.concat(F.lit("unknown:"), row.cast("string")))


def nested_export(services: DataFrame, cases: DataFrame, points: DataFrame) -> DataFrame:
    """Services with their cases and the points of each case, as nested arrays; services without points have none.

    Points without a service or case are left out; a case that is only named by points keeps its id alone.
    """
    valid = points.where(F.col("service_id").isNotNull() & F.col("case_id").isNotNull())
    names = [c for c in valid.columns if c not in ("service_id", "case_id")]
    per_case = valid.groupBy("service_id", "case_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("points"))
    told = per_case.join(cases, "case_id", "left")
    own = [c for c in cases.columns if c != "case_id"]
    per_service = told.groupBy("service_id").agg(F.array_sort(F.collect_list(F.struct("case_id", *own, "points"))).alias("cases"))
    joined = services.join(per_service, "service_id", "left")
    return joined.withColumn("cases", F.coalesce("cases", F.array().cast(per_service.schema["cases"].dataType)))
