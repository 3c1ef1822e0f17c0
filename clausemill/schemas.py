"""Schemas of the tables that operators pass to each other, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATION_LONG = (
    "text string, normalized_text string, source_dataset string, source_id string, service_name string, platform string, company string, "
    "topic_id string, topic_index int, mapped_score int, presence_label double, native_label string, native_tag string, native_score string, "
    "parse_status string, mapping_rule string, metadata_json string"
)
CLAUSE_WIDE = (
    "text string, normalized_text string, sources array<string>, labels_presence array<double>, topic_mask array<double>, scores array<int>, "
    "topic_scores map<string,int>, active_topic_ids array<string>, conflict_topic_ids array<string>, has_score_conflict boolean, "
    "harm_score int, harm_score_class int, harm_mask double, "
    "native_annotations array<struct<source_dataset:string,source_id:string,topic_id:string,mapped_score:int,native_label:string,native_tag:string,mapping_rule:string>>"
)
PREDICTION = (
    "chunk_id long, paragraph_id long, text string, estimated_tokens long, is_subchunk boolean, topic_probabilities map<string,double>, "
    "predicted_topics array<string>, harm_probabilities map<string,double>, predicted_harm_class string, harm_confidence double"
)
EVENT = (
    "server_ts string, participant_id string, session_id string, seq long, t_ms long, event_type string, screen string, client_id string, "
    "client_seq long, client_ts string, app_commit string, data string"
)
RAW_PREDICTION = "row_id long, raw_json string, parsed_topics array<string>, parsed_risk string, parse_ok boolean, latency_s double"
LONG_CELL = "row_id long, topic_index int, label double, mask double, score int"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself; an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def first_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the frame has."""
    return next((n for n in names if n in df.columns), None)


def with_columns_of(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns in order; those the frame lacks are null of the given type."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the count of rows that break each rule, in one pass; a null verdict breaks it."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def assert_no_violations(df: DataFrame, rules: dict[str, Column]) -> None:
    row = violations(df, rules).first().asDict()
    if bad := {k: v for k, v in row.items() if v}:
        raise ValueError(f"rules are broken: {bad}")


def annotation_rules(topics: list[str]) -> dict[str, Column]:
    """Rules of the long annotation table: known topic, score in -1, 0, 1, some text."""
    return {
        "known_topic": F.col("topic_id").isin(topics),
        "score_domain": F.col("mapped_score").isin(-1, 0, 1),
        "has_text": F.coalesce(F.length("normalized_text"), F.lit(0)) > 0,
        "binary_label": F.col("presence_label").isin(0.0, 1.0),
    }
