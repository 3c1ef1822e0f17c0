"""The document flow end to end: text to clause list, explanations, and the comparison of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import documents, scoring, similarity
from clausemill.operators.ledger import Ledger, digest
from clausemill.session import dropped, packed

HARM = ("Harmful", "Neutral", "Fair")


def analyze(docs: DataFrame, scorer: scoring.Scorer, limit: int = 256, separator: str = r"\n\n", ledger: Ledger | None = None) -> DataFrame:
    """Predictions of every chunk of (doc_id, text): chunk, topic, harm class.

    The scorer answers a JSON object with score -1, 0 or 1 and a title, which names the topic. It sees each distinct
    text once, and none that the ledger knows; rows keep their number, also where ids repeat or are null.
    """
    pieces = documents.document_chunks(docs, separator=separator, limit=limit)
    return _predictions((ledger or Ledger(docs.sparkSession)).answered(pieces, scorer), pieces.columns)


def _predictions(answers: DataFrame, columns: list[str]) -> DataFrame:
    told = scoring.parsed(answers).withColumn("topic", F.get_json_object(T.unfenced(F.col("raw")), "$.title"))
    names = F.array(*map(F.lit, HARM))
    return told.select(
        *columns,
        F.when(F.col("topic").isNotNull(), F.array("topic")).otherwise(F.expr("array()").cast("array<string>")).alias("predicted_topics"),
        F.get(names, F.col("score") + 1).alias("predicted_harm_class"),
        F.when(F.col("score").isNotNull(), 1.0).alias("harm_confidence"),
    )


def explain(predictions: DataFrame, scorer: scoring.Scorer, harm: list[str] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Title and description for the clauses of the asked harm classes; the filter comes before the costly calls."""
    wanted = predictions.where(F.col("predicted_harm_class").isin(documents.harm_filter(harm))).select("doc_id", "chunk_id", "text", "predicted_harm_class")
    answers = scoring.parsed((ledger or Ledger(predictions.sparkSession)).answered(wanted, scorer)).where("complete")
    body = T.unfenced(F.col("raw"))
    return answers.select(*wanted.columns, F.get_json_object(body, "$.title").alias("title"), F.get_json_object(body, "$.description").alias("description"))


def version_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two versions of documents, from their predictions: chunks of one side only, merged and ordered.

    A chunk is unchanged if its change text is on both sides; an old and a new chunk of one paragraph are one
    modification, others are additions and removals. Both sides are read twice. ``compared`` goes from texts to changes
    with less on disk.
    """
    return _changes(packed(_alone(old, new), "gone"), packed(_alone(new, old), "came"))


def compared(old: DataFrame, new: DataFrame, scorer: scoring.Scorer, limit: int = 256, separator: str = r"\n\n", ledger: Ledger | None = None) -> DataFrame:
    """``version_changes`` of ``analyze`` of both versions (doc_id, text).

    All chunks of both are put to the scorer, each distinct text once; chunks are compared before they meet their
    answers, so whole texts are written once and shuffled once to be asked and once to be compared, and only what differs is kept.
    """
    ledger = ledger or Ledger(old.sparkSession)
    sides = []
    for docs in (old, new):
        sides.append(packed(documents.document_chunks(docs, separator=separator, limit=limit), "rows"))
        ledger.ask(sides[-1], scorer)
    a, b = sides
    gone, came = packed(_alone(a, b), "gone"), packed(_alone(b, a), "came")
    for side in sides:
        dropped(side)
    return _changes(*(packed(_predictions(ledger.told(x, scorer), x.columns), "told") for x in (gone, came)))


def _alone(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows whose change text no other row of their document has, by 128 bits of it."""
    keyed = lambda df: df.withColumn("__t", digest(T.change_text(F.col("text"))))
    return keyed(rows).join(keyed(others.select("doc_id", "text")).select("doc_id", "__t").distinct(), ["doc_id", "__t"], "left_anti").select(*rows.columns)


def _changes(gone: DataFrame, came: DataFrame) -> DataFrame:
    pairs = gone.select("doc_id", "paragraph_id").distinct().withColumn("__both", F.lit(True))
    new_rows = came.join(pairs, ["doc_id", "paragraph_id"], "left").withColumn("change_type", F.when(F.col("__both"), "modified").otherwise("added")).drop("__both")
    left = gone.join(came.select("doc_id", "paragraph_id").distinct(), ["doc_id", "paragraph_id"], "left_anti").withColumn("change_type", F.lit("removed"))
    rows = new_rows.unionByName(left).select("doc_id", F.col("chunk_id").alias("pos"), F.col("text").alias("what_changed"), F.lower("predicted_harm_class").alias("harm_label"), "change_type")
    return similarity.merged_changes(rows)


def comparison_summary(baseline: DataFrame, grouped: DataFrame, calls: DataFrame, key: str = "row_id") -> DataFrame:
    """Agreement of grouped scores with single ones and with the truth, macro F1 of both, and the calls saved.

    ``baseline`` has truth and score, ``grouped`` score, by row.
    """
    from clausemill.operators import metrics

    both = baseline.select(key, "truth", F.col("score").alias("single")).join(grouped.select(key, F.col("score").alias("group")), key, "left")
    agreed = metrics.agreement(both.select(F.col("single").alias("a"), F.col("group").alias("b"))).select("rows", "valid_rows", "agreement")
    f1 = lambda c, name: metrics.class_summary(metrics.confusion(both.select("truth", F.col(c).alias("predicted"), F.lit(1.0).alias("mask")))).select(F.col("macro_f1").alias(name))
    saved = scoring.call_summary(baseline, calls).select("calls", "reduction_percent")
    return agreed.crossJoin(f1("single", "single_f1")).crossJoin(f1("group", "group_f1")).crossJoin(saved)
