"""A ledger of calls: every distinct text is put to a scorer once, and its answer is kept.

Answers are a table keyed by (scorer and version, digest of the text), in a folder for each scorer. Before a call texts
and known digests are dealt to small tasks by the digest, once, and what is known is left out there; what is missing is
asked in these, in waves that are each committed, so a lost task asks its own few texts again and a job that breaks off
keeps the waves before; after it, all answers are joined to the rows by the digest. So computing a result again, in whole or in part, calls nothing, rows
with one text get one answer, and rows keep their number whatever ids they have.

An answer that fails, or that ``accept`` refuses, is asked again after a wait that doubles; then the fallback scorer is
asked, if there is one. What failed is told with its error and not known, so the next call tries again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators.scoring import Scorer
from clausemill.session import checkpoint_dir, exists, packed, tidy

SCHEMA = "digest binary, raw string, latency_s double, error string, answered_by string, attempts int, at long"
#: Tasks that all waves of a call have at most, give or take a wave: beyond it a task holds more texts.
MOST_TASKS = 8192
#: What ``answered`` adds to the rows.
ADDED = ("raw", "latency_s", "error", "answered_by")


def digest(text: Column) -> Column:
    """128 bits of a text; a null text counts as the empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


def named(scorer: Scorer) -> str:
    """The folder of a scorer: a digest of all that it says of itself, so another version is another folder."""
    return hashlib.sha256(json.dumps(scorer.info(), sort_keys=True, default=str).encode()).hexdigest()[:32]


def asker(scorer: Scorer, batch: int, retries: int, wait_s: float, fallback: Scorer | None, accept: Callable[[str], bool] | None):
    """A function of pandas frames (digest, text) to SCHEMA rows."""

    def tried(who: Scorer, texts: list[str], times: int) -> tuple[list[str | None], list[str | None], list[int]]:
        """Answers, errors and attempts; only texts without an accepted answer are asked again."""
        answers: list[str | None] = [None] * len(texts)
        errors: list[str | None] = ["not asked"] * len(texts)
        attempts = [0] * len(texts)
        for k in range(times):
            open_ = [i for i, e in enumerate(errors) if e is not None]
            if not open_:
                break
            if k and wait_s:
                time.sleep(wait_s * 2 ** (k - 1))
            try:
                told = who.score([texts[i] for i in open_])
                if len(told) != len(open_):
                    raise ValueError(f"{len(told)} answers to {len(open_)} texts")
            except Exception as e:  # a scorer's failure is a result of the row
                for i in open_:
                    errors[i], attempts[i] = f"{type(e).__name__}: {e}", attempts[i] + 1
                continue
            for i, a in zip(open_, told, strict=True):
                attempts[i] += 1
                answers[i], errors[i] = a, None if accept is None or accept(a) else "not accepted"
        return answers, errors, attempts

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        scorer.open()
        opened = False
        for pdf in frames:
            parts = []  # one frame out for one in: frames of a batch each cost more than many a scorer
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                texts, began = own["text"].fillna("").tolist(), time.monotonic()
                answers, errors, attempts = tried(scorer, texts, retries + 1)
                by = [named(scorer)] * len(texts)
                left = [i for i, e in enumerate(errors) if e is not None]
                if left and fallback is not None:
                    if not opened:
                        fallback.open()
                        opened = True
                    for i, a, e, n in zip(left, *tried(fallback, [texts[i] for i in left], 1), strict=True):
                        answers[i], errors[i], attempts[i], by[i] = a, e, attempts[i] + n, named(fallback)
                each = (time.monotonic() - began) / len(texts)
                at_ms = time.time_ns() // 1_000_000
                parts.append((answers, [each] * len(texts), errors, by, attempts, [at_ms] * len(texts)))
            told = [[x for p in parts for x in p[i]] for i in range(6)]
            yield pd.DataFrame({"digest": pdf["digest"].to_numpy(), **dict(zip(("raw", "latency_s", "error", "answered_by", "attempts", "at"), told, strict=True))})

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows without those whose digest it has had, so a text that many rows share is not dealt as often."""
    for batch in batches:
        first = np.unique(batch.column(0).dictionary_encode().indices.to_numpy(), return_index=True)[1]
        yield batch if len(first) == batch.num_rows else batch.take(pa.array(first))


class Ledger:
    """Answers by scorer and text under ``path``; a folder of its own in the checkpoint folder where none is named."""

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        batch: int = 16,
        per_task: int = 256,
        wave_tasks: int = 4096,
        retries: int = 1,
        wait_s: float = 0.0,
        fallback: Scorer | None = None,
        accept: Callable[[str], bool] | None = None,
    ):
        self.spark, self.path = spark, path or f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        self.per_task, self.wave_tasks = per_task, wave_tasks
        self.options = {"batch": batch, "retries": retries, "wait_s": wait_s, "fallback": fallback, "accept": accept}

    def answers(self, scorer: Scorer) -> DataFrame:
        """One row a text that the scorer was asked: its answer, or its last failure."""
        at = f"{self.path}/{named(scorer)}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], SCHEMA)
        best = F.min_by(F.struct("raw", "latency_s", "error", "answered_by", "attempts", "at"), F.struct(F.col("error").isNotNull(), -F.col("at")))
        return self.spark.read.schema(SCHEMA).parquet(at).groupBy("digest").agg(best.alias("a")).select("digest", "a.*")

    def ask(self, rows: DataFrame, scorer: Scorer, text: str = "text") -> int:
        """Puts the texts that the ledger lacks to the scorer; how many they were. The rows are read to count digests, and by each wave."""
        at = f"{self.path}/{named(scorer)}"
        found = self.spark.read.schema(SCHEMA).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], SCHEMA)
        known = found.where("error IS NULL").select("digest")
        wanted = rows.select(digest(F.col(text)).alias("digest"), F.col(text).cast("string").alias("text"))
        with tidy(self.spark):
            n = wanted.select("digest").distinct().join(known, "digest", "left_anti").count()
            per_task = max(self.per_task, -(-n // MOST_TASKS))
            waves = max(1, -(-n // (per_task * self.wave_tasks)))
            tasks = max(1, min(self.wave_tasks, -(-n // (waves * per_task))))
            own = lambda df, k: df.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == k) if waves > 1 else df
            for k in range(waves if n else 0):
                texts = own(wanted, k).mapInArrow(_once, wanted.schema).withColumn("known", F.lit(False))
                both = texts.unionByName(own(known, k).select("digest", F.lit(None).cast("string").alias("text"), F.lit(True).alias("known")))
                # dealt once: the groups are made where the texts are asked
                asked = both.repartition(tasks, "digest").groupBy("digest").agg(F.first("text", ignorenulls=True).alias("text"), F.max("known").alias("known"))
                told = asked.where(~F.col("known")).select("digest", "text").mapInPandas(asker(scorer, **self.options), SCHEMA)
                told.write.mode("append").option("compression", "zstd").parquet(at)
        return n

    def answered(self, rows: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
        """The rows with ``raw``, ``latency_s``, ``error`` and ``answered_by``; columns of these names give way."""
        rows = packed(rows.drop(*ADDED), "rows")  # read more than once
        self.ask(rows, scorer, text)
        return self.told(rows, scorer, text)

    def told(self, rows: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
        """``answered`` for rows whose texts, and maybe others, were asked before: nothing is asked or written."""
        told = self.answers(scorer).select(F.col("digest").alias("__digest"), *ADDED)
        return rows.withColumn("__digest", digest(F.col(text))).join(told, "__digest", "left").select(*rows.columns, *ADDED)
