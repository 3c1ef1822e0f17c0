"""External scorers behind an interface, and the operators around their runs.

A scorer is a plain object that is sent to the executors once per task. The default one is deterministic, for
tests; a model or a service takes its place by the same protocol.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators.relational import running_sum


class Scorer(Protocol):
    def info(self) -> dict: ...

    def open(self) -> None:
        """Called once in each task before the first batch."""

    def score(self, texts: list[str]) -> list[str]:
        """One answer for each text."""


class HashScorer:
    """Answers a JSON object with a score in -1, 0, 1 and a title, from a hash of the text."""

    def __init__(self, name: str = "hash", fail_every: int = 0):
        self.name, self.fail_every = name, fail_every

    def info(self) -> dict:
        return {"model": self.name, "device": "none", "classes": 3}

    def open(self) -> None:
        pass

    def score(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            n = int.from_bytes(hashlib.md5(f"{self.name}:{t}".encode()).digest()[:4], "big")
            out.append("no answer" if self.fail_every and n % self.fail_every == 0 else json.dumps({"score": n % 3 - 1, "title": f"t{n % 7}", "description": t[:20]}, ensure_ascii=False))
        return out


def scored(rows: DataFrame, scorer: Scorer, text: str = "text", row_id: str = "row_id", batch: int = 16, retries: int = 1) -> DataFrame:
    """(row_id, raw, latency_s, error): answers in batches of ``batch``; a batch that raises is tried again, then reported."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        scorer.open()
        for pdf in frames:
            parts = []
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                texts, began, error, answers = own["text"].fillna("").tolist(), time.monotonic(), None, [None] * len(own)
                for _ in range(retries + 1):
                    try:
                        answers, error = scorer.score(texts), None
                        break
                    except Exception as e:  # a scorer's failure is a result of the row
                        error = f"{type(e).__name__}: {e}"
                parts.append(pd.DataFrame({"row_id": own["row_id"], "raw": answers, "latency_s": (time.monotonic() - began) / len(own), "error": error}))
            if parts:
                yield pd.concat(parts)

    source = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return source.mapInPandas(run, "row_id long, raw string, latency_s double, error string")


def parsed(answers: DataFrame) -> DataFrame:
    """Adds ``score`` and ``parse_ok``: from the JSON object, else from the first standalone score of the text."""
    body = T.unfenced(F.col("raw"))
    told = F.from_json(body, "struct<score:int,title:string,description:string>")
    score = F.coalesce(told["score"], T.recovered_score(F.col("raw")))
    valid = F.when(score.isin(-1, 0, 1), score)
    complete = (F.coalesce(F.trim(told["title"]), F.lit("")) != "") & (F.coalesce(F.trim(told["description"]), F.lit("")) != "")
    return answers.select(*answers.columns, valid.alias("score"), valid.isNotNull().alias("parse_ok"), complete.alias("complete"))


def last_attempts(log: DataFrame, row_id: str = "row_id", pos: str = "pos") -> DataFrame:
    """The last attempt of every row in a run log."""
    by = Window.partitionBy(row_id).orderBy(F.desc(pos))
    return log.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def remaining(rows: DataFrame, log: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows without a successful attempt: finished ones are skipped, failed ones tried again."""
    return rows.join(log.where("parse_ok").select(row_id).distinct(), row_id, "left_anti")


def batches(rows: DataFrame, size: int, group: str, order: str) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows of a group in order, numbered by range, so that no group is one task."""
    placed = running_sum(rows, F.lit(1).cast("long"), "__n", [order], [group])
    return placed.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def prompts(batched: DataFrame, group: str, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """One prompt a batch: a JSON list of its rows, in order of id."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("id"), F.col(text).alias("text"))))
    return batched.groupBy(group, "batch").agg(F.to_json(rows).alias("prompt"), F.count("*").alias("n_rows"))


def grouped_answers(batched: DataFrame, answers: DataFrame, group: str, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Scores by row from batch answers (group, batch, raw: list of {id, score}), and the rows left for single calls."""
    listed = F.explode(F.from_json(T.unfenced(F.col("raw")), "array<struct<id:bigint,score:int>>"))
    told = answers.select(group, "batch", listed.alias("a")).select(group, "batch", F.col("a.id").alias(row_id), F.col("a.score").alias("score"))
    told = told.where(F.col("score").isin(-1, 0, 1)).dropDuplicates([group, "batch", row_id])
    joined = batched.join(told, [group, "batch", row_id], "left")
    return joined.where("score IS NOT NULL"), joined.where("score IS NULL").drop("score")


def call_summary(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls against rows and the reduction in percent."""
    a, b = rows.agg(F.count("*").alias("rows")), calls.agg(F.count("*").alias("calls"))
    return a.crossJoin(b).withColumn("reduction_percent", F.when(F.col("rows") > 0, 100.0 * (1 - F.col("calls") / F.col("rows"))).otherwise(0.0))


def resolved_labels(predictions: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, topic indexes) of predicted labels found by id or normalised name, and the count of labels that are neither."""
    keys = topics.select("topic_index", F.explode(F.array_distinct(F.array(T.label_key(F.col("topic_id")), T.label_key(F.col("name"))))).alias("key"))
    keys = keys.groupBy("key").agg(F.min("topic_index").alias("topic_index"))
    each = predictions.select("row_id", F.explode_outer("labels").alias("label")).withColumn("key", T.label_key(F.col("label")))
    told = each.join(F.broadcast(keys), "key", "left")
    rows = told.groupBy("row_id").agg(F.sort_array(F.collect_set("topic_index")).alias("topics"))
    return rows, told.agg(F.count_if(F.col("label").isNotNull() & F.col("topic_index").isNull()).alias("dropped"))


def run_diagnostics(rows: DataFrame) -> DataFrame:
    """Parse failures, classes used, and the middle and largest number of topics of a run."""
    n = F.size(F.coalesce("topics", F.expr("array()").cast("array<int>")))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("parse_ok")).alias("failures"), F.countDistinct("risk").alias("classes_used"),
        F.percentile(n, F.lit(0.5)).alias("median_topics"), F.max(n).alias("most_topics"),
    )


def best_run(runs: DataFrame, *keys: str, value: str = "best_val", run: str = "run_id") -> DataFrame:
    """The run with the largest value for each key; the least id on ties."""
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in runs.columns if c not in keys]), F.struct(-F.col(value), F.col(run))).alias("r")).select(*keys, "r.*")


def run_matrix(spark, encoders: list[str], seeds: list[int], heads: list[str], ablation: tuple[str, str] | None = None) -> DataFrame:
    """Every (encoder, seed, heads) of an experiment and its run id."""
    rows = [(e, s, heads[0]) for e in encoders for s in seeds] + ([(ablation[0], s, ablation[1]) for s in seeds] if ablation else [])
    df = spark.createDataFrame(sorted(set(rows)), "encoder string, seed int, heads string")
    return df.withColumn("run_id", T.run_id(F.col("encoder"), F.concat(F.lit("seed"), F.col("seed").cast("string")), F.col("heads")))


def answer_span(starts: Column, ends: Column, words: Column, most: int = 200, none: str = "No Answer") -> Column:
    """The words between the most likely start and end; ``none`` where they cross or are too far apart."""
    a, b = F.array_position(starts, F.array_max(starts)).cast("int"), F.array_position(ends, F.array_max(ends)).cast("int")
    return F.when((b < a) | (b - a + 1 > most) | (a < 1), F.lit(none)).otherwise(F.array_join(F.slice(words, a, b - a + 1), " "))


def two_stage(rows: DataFrame, topics: Scorer, risk: Scorer, rubrics: DataFrame, ledger=None) -> DataFrame:
    """Topics first, then the risk with the rubric of the topic found only; each scorer sees each distinct text once."""
    from clausemill.operators.ledger import Ledger

    ledger = ledger or Ledger(rows.sparkSession)
    first = ledger.answered(rows, topics).withColumn("topic", F.get_json_object(T.unfenced(F.col("raw")), "$.title"))
    told = first.join(rubrics.select("topic", "rubric"), "topic", "left").withColumn("asked", F.concat_ws("\n", "text", "rubric"))
    second = parsed(ledger.answered(told.select("row_id", "topic", "asked"), risk, "asked"))
    return second.select("row_id", "topic", "score", "parse_ok")


def rubric_text(scores: DataFrame, *keys: str) -> DataFrame:
    """``score: description`` lines in order of score, for each key."""
    line = lambda x: F.concat_ws(": ", x["score"].cast("string"), x["description"])
    return scores.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score", "description"))), line), "\n").alias("rubric"))


def graded_retrieval(questions: DataFrame, retrieve, grader: Scorer, rounds: int = 2, ledger=None) -> DataFrame:
    """Retrieve, grade every chunk, and ask again with an expanded query where none passes, for a few rounds.

    ``retrieve(questions) -> (query_id, chunk_id, text)``; a grade of 1 passes. What a round passes is written, so later
    rounds and readers of the result neither retrieve nor grade again.
    """
    from clausemill.operators.ledger import Ledger
    from clausemill.session import written

    ledger = ledger or Ledger(questions.sparkSession)
    open_, done = questions, None
    for k in range(rounds):
        found = retrieve(open_).select("query_id", "chunk_id", "text")
        passed = parsed(ledger.answered(found, grader)).where("score = 1").select("query_id", "chunk_id", F.lit(k).alias("round"))
        passed = written(passed, f"passed-{k}")
        done = passed if done is None else done.unionByName(passed)
        open_ = open_.join(passed.select("query_id").distinct(), "query_id", "left_anti").withColumn("query", F.concat_ws(" ", "query", F.lit("agreement clause")))
    return done
