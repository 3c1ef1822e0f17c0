"""The training-text pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Its result is written as
Parquet in the shared folder of ``spark.checkpoint.dir`` and read again, which cuts the lineage, so a lost
executor costs no earlier stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.decontaminate import decontaminate
from clausemill.llm.jaccard import keep_one
from clausemill.llm.line_dedup import dedup_lines
from clausemill.llm.packing import pack_documents
from clausemill.llm.quality import line_first_quality
from clausemill.llm.store import Store

#: What stages have left in the shared folder, by application, input and thread, so that no run meets another's.
_LEFT: dict[tuple, list[Store]] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, threading.get_ident()


def _read_from(docs: DataFrame) -> list[str]:
    """The folders that a DataFrame reads files from."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves().iterator()
    found = []
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths().iterator()
            while roots.hasNext():
                found.append(roots.next().toUri().getPath())
    return found


def _folder(store: Store) -> str:
    """The folder of a store without scheme and host."""
    return store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.path).toUri().getPath()


def _clear(key: tuple, docs: DataFrame | None = None) -> None:
    """Drops what a run's stages have left, but for what ``docs`` still reads, as the result of a stage that is not written yet does."""
    left = _LEFT.pop(key, [])
    roots = _read_from(docs) if docs is not None and left else []
    for store in left:
        own = _folder(store)
        if any(r == own or r.startswith(f"{own}/") for r in roots):
            _LEFT.setdefault(key, []).append(store)
        else:
            store.remove()


def _stage(f):
    """A stage that first drops what the stages before it in its run have left in the shared folder."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = _key(spark, sf_dir)
        _clear(key, docs)
        with Store.noted() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.setdefault(key, []).extend(made)
        return out

    return run


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    judged = line_first_quality(docs.select(*COLUMNS))
    # behind a generator: the optimizer would repeat all rules in a filter below and work them out twice
    told = judged.select("doc_id", "lang", "source", F.inline(F.array(F.struct(F.col("clean_text").alias("text"), "kept"))))
    return told.where("kept").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which no word is left goes with them."""
    done = dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_deleted") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return done.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs.select(*COLUMNS))


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in windows of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Tokenising and suffix order are beyond SQL; tests/llm holds run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{k}")
        _clear(_key(spark, sf_dir))
        if k:
            store.drop(f"stage-{k - 1}")
    return docs
