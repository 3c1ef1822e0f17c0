"""The ledger of calls: each distinct text once, whatever reads the result, and rows that keep their number."""

import json
import subprocess
import sys
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausemill.operators import analysis, retrieval, scoring
from clausemill.operators.ledger import Ledger


class Counting(scoring.HashScorer):
    """Notes every text it is asked in a file, across worker processes."""

    def __init__(self, name, log):
        super().__init__(name)
        self.log = str(log)

    def score(self, texts):
        with open(self.log, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().score(texts)


def asked(log):
    try:
        with open(log) as f:
            return Counter(json.loads(x) for x in f)
    except FileNotFoundError:
        return Counter()


def docs(spark):
    rows = [(1, "One thing is said.\n\nAnother thing is said."), (1, "One thing is said."), (None, "One thing is said."), (None, "The last is said."), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_analysis_keeps_rows_and_asks_once(spark, tmp_path):
    scorer, ledger = Counting("a", tmp_path / "log"), Ledger(spark, f"{tmp_path}/ledger", per_task=2)
    out = analysis.analyze(docs(spark), scorer, ledger=ledger)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, "One thing is said."), (1, "Another thing is said."), (1, "One thing is said."), (0, "One thing is said."), (0, "The last is said.")])
    out.count()
    explained = analysis.explain(out, Counting("e", tmp_path / "explained"), ledger=ledger)
    explained.collect(), explained.count()
    assert set(asked(tmp_path / "log").values()) == {1} and len(asked(tmp_path / "log")) == 3
    assert set(asked(tmp_path / "explained").values()) <= {1}
    # the same again calls nothing; another version of the scorer is asked anew
    analysis.analyze(docs(spark), scorer, ledger=ledger).collect()
    assert sum(asked(tmp_path / "log").values()) == 3
    analysis.analyze(docs(spark), Counting("a2", tmp_path / "log"), ledger=ledger).collect()
    assert sum(asked(tmp_path / "log").values()) == 6


def test_two_versions_two_stages_and_graded_retrieval_ask_once(spark, tmp_path):
    old = spark.createDataFrame([(k, f"Part {k} of the terms.\n\nPart {k + 1} of the terms.") for k in range(20)], "doc_id long, text string")
    new = old.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("New. "), "text")).otherwise(F.col("text")))
    ledger, scorer = Ledger(spark), Counting("v", tmp_path / "versions")
    changes = analysis.version_changes(*(analysis.analyze(x, scorer, ledger=ledger) for x in (old, new)))
    assert changes.count() == len(changes.collect()) > 0
    assert set(asked(tmp_path / "versions").values()) == {1} and len(asked(tmp_path / "versions")) == 25

    rows = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "row_id long, text string")
    rubrics = spark.createDataFrame([(f"t{k}", f"rubric {k}") for k in range(7)], "topic string, rubric string")
    told = scoring.two_stage(rows, Counting("t", tmp_path / "topics"), Counting("r", tmp_path / "risk"), rubrics)
    assert told.count() == len(told.collect()) == 40
    for log in ("topics", "risk"):
        assert len(asked(tmp_path / log)) == 7 and set(asked(tmp_path / log).values()) == {1}
    topic_of = {t: json.loads(scoring.HashScorer("t").score([t])[0])["title"] for t in asked(tmp_path / "topics")}
    assert set(asked(tmp_path / "risk")) == {f"{t}\nrubric {topic[1:]}" for t, topic in topic_of.items()}

    questions = spark.createDataFrame([(k, f"question {k}") for k in range(6)], "query_id long, query string")
    chunks = spark.createDataFrame([(k, f"chunk {k}") for k in range(5)], "chunk_id long, text string")
    pairs = lambda q: q.join(chunks, F.pmod("chunk_id", F.lit(2)) == F.pmod("query_id", F.lit(2))).select("query_id", "chunk_id", F.concat_ws(" ", "query", "text").alias("text"))
    graded = scoring.graded_retrieval(questions, pairs, Counting("g", tmp_path / "grades"), rounds=3)
    assert graded.count() == len(graded.collect()) and set(asked(tmp_path / "grades").values()) == {1}
    best = retrieval.reranked(pairs(questions).join(questions, "query_id"), Counting("k", tmp_path / "ranks"), 1)
    assert best.count() == 6 and set(asked(tmp_path / "ranks").values()) == {1}


class Shaky(Counting):
    """Fails at the first call for a text, answers nonsense at the second."""

    def score(self, texts):
        seen = asked(self.log)
        out = super().score(texts)
        if any(seen[t] == 0 for t in texts):
            raise TimeoutError("busy")
        return ["nonsense" if seen[t] == 1 else a for t, a in zip(texts, out, strict=True)]


def test_tries_again_then_asks_the_fallback_and_tells_what_failed(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k % 3}", "own") for k in range(9)], "row_id long, text string, raw string")
    valid = lambda a: a.startswith("{")
    told = Ledger(spark, batch=1, retries=2, accept=valid).answered(rows, Shaky("s", tmp_path / "a")).collect()
    assert len(told) == 9 and all(r.error is None and valid(r.raw) for r in told) and set(asked(tmp_path / "a").values()) == {3}
    failing = Ledger(spark, f"{tmp_path}/l", batch=1, retries=1, accept=valid)
    told = failing.answered(rows, Shaky("s", tmp_path / "b")).collect()
    assert {r.error for r in told} == {"not accepted"}
    assert failing.ask(rows, Shaky("s", tmp_path / "b")) == 3  # not known: asked again, and answered
    assert {r.error for r in failing.answered(rows, Shaky("s", tmp_path / "b")).collect()} == {None}
    backed = Ledger(spark, batch=2, retries=0, fallback=scoring.HashScorer("other"), wait_s=0.01)
    told = backed.answered(rows, Shaky("s", tmp_path / "c")).collect()
    assert {r.raw for r in told} == set(scoring.HashScorer("other").score([f"text {k}" for k in range(3)]))
    assert all(r.latency_s >= 0 for r in told)


def test_waves_are_committed_one_by_one(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("text "), "id").alias("text"))
    ledger = Ledger(spark, f"{tmp_path}/l", per_task=10, wave_tasks=4)
    assert ledger.answered(rows, Counting("w", tmp_path / "log")).where("error IS NULL").count() == 500
    assert set(asked(tmp_path / "log").values()) == {1} and len(asked(tmp_path / "log")) == 500


@pytest.mark.parametrize("kill", ["text 37"])
def test_a_killed_task_asks_its_own_texts_again_and_no_others(tmp_path, kill):
    code = f"""
        import json, os
        from pyspark.sql import functions as F
        from clausemill.session import local_session
        from clausemill.operators.ledger import Ledger
        from clausemill.operators.scoring import HashScorer
        class Killing(HashScorer):
            def score(self, texts):
                with open({str(tmp_path / "log")!r}, "a") as f:
                    f.writelines(json.dumps(t) + "\\n" for t in texts)
                if {kill!r} in texts and not os.path.exists({str(tmp_path / "killed")!r}):
                    open({str(tmp_path / "killed")!r}, "w").close()
                    os._exit(1)
                return super().score(texts)
        spark = local_session("2,4", "killed", shuffle=2)
        rows = spark.range(200).select((F.col("id") % 100).alias("row_id"), F.concat(F.lit("text "), F.col("id") % 100).alias("text"))
        out = Ledger(spark, {str(tmp_path / "l")!r}, batch=4, per_task=10).answered(rows, Killing("k"))
        assert out.count() == 200 and out.where("raw IS NULL").count() == 0
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=300)
    calls = asked(tmp_path / "log")
    assert len(calls) == 100 and max(calls.values()) == 2 and sum(n == 2 for n in calls.values()) <= 25


def test_tasks_do_not_grow_with_the_texts(spark, tmp_path, monkeypatch):
    from clausemill.operators import ledger, scoring

    monkeypatch.setattr(ledger, "MOST_TASKS", 3)
    rows = spark.range(40).select(F.col("id").cast("string").alias("text"))
    book = ledger.Ledger(spark, f"{tmp_path}/book", batch=4, per_task=1, wave_tasks=2)
    told = book.answered(rows, scoring.HashScorer())
    assert told.where("error IS NULL AND raw IS NOT NULL").count() == 40
    assert len(list(tmp_path.glob("book/*/part-*"))) <= 4


def test_compared_versions_keep_only_what_differs(spark, tmp_path, monkeypatch):
    import random

    from clausemill import session
    from clausemill.operators import ledger

    from __spark_entry__ import queries

    r = random.Random(4)
    line = lambda: " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(40)) + "."
    rows = [(k, "\n".join(line() for _ in range(30))) for k in range(60)] + [(90, None), (91, ""), (92, "Too short")]
    old = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    old.write.parquet(f"{tmp_path}/in/documents.parquet")
    for module in (session, ledger):
        monkeypatch.setattr(module, "checkpoint_dir", lambda spark: f"{tmp_path}/own")
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet") if p.is_file())
    found = sorted(map(tuple, queries()["version_changes"](spark, f"{tmp_path}/in").collect()))
    assert size("own") < size("in/documents.parquet")  # no copy of the texts of both versions stays
    new = old.withColumn("text", F.concat(F.regexp_replace("text", r"\A\S+", "Changed"), F.lit("\nThis paragraph is new and of some length.")))
    book = Ledger(spark, f"{tmp_path}/book")
    sides = [analysis.analyze(x, scoring.HashScorer(), separator="\n", ledger=book) for x in (old, new)]
    assert found == sorted(map(tuple, analysis.version_changes(*sides).collect())) and len(found) >= 120
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_texts_are_dealt_once_to_be_asked(spark, tmp_path, monkeypatch):
    from clausemill import session
    from clausemill.operators import ledger

    for module in (session, ledger):
        monkeypatch.setattr(module, "checkpoint_dir", lambda spark: f"{tmp_path}/own")
    plans, frame = [], type(spark.range(0))
    told = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema: plans.append(self._jdf.queryExecution().executedPlan().toString()) or told(self, f, schema))
    rows = spark.range(100).select((F.col("id") % 50).cast("string").alias("text"))
    book = Ledger(spark, f"{tmp_path}/l")
    assert book.ask(rows, scoring.HashScorer()) == 50 and book.ask(rows.union(spark.sql("SELECT 'new'")), scoring.HashScorer()) == 1
    assert len(plans) == 2 and all(p.count("Exchange") == 1 for p in plans) and not list(tmp_path.glob("own/*"))  # nor is a table of them written
    assert book.answers(scoring.HashScorer()).count() == 51
