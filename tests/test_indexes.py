"""The stored inverted index and the vector index against full searches."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import retrieval, vector_index
from clausemill.operators.inverted import InvertedIndex
from clausemill.operators.vector_index import VectorIndex


def corpus(spark, seed, n=1500):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    text = lambda: " ".join(r.choices(words, weights, k=r.randint(0, 60)))
    chunks = [(k, text()) for k in range(n)] + [(n, None), (n + 1, "")]
    queries = [(k, " ".join(r.choices(words, weights, k=4)) + f" w{380 + k % 20}") for k in range(15)] + [(90, "w0"), (91, "nowhere"), (92, ""), (93, "w0 w0 w1")]
    return spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("span, k", [(8, 5), (64, 25), (10_000, 3)])
def test_index_gives_the_ranks_of_a_full_search(spark, tmp_path, span, k):
    chunks, queries = corpus(spark, span)
    index = InvertedIndex.build(chunks, f"{tmp_path}/index", span=span)
    found, read = index.search(queries, k)
    want = {(r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieval.bm25(queries, chunks, k).collect()}
    assert {(r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in found.collect()} == want
    told = {r.query_id: (r.read, r.of) for r in read.collect()}
    assert all(a <= b for a, b in told.values()) and (span > 8 or sum(a for a, _ in told.values()) < 0.7 * sum(b for _, b in told.values()))
    if span == 8:  # the list of the most frequent word, asked for alone, is not read whole
        assert told[90][0] < 0.5 * told[90][1]


def test_an_index_that_is_there_is_read(spark, tmp_path):
    chunks, queries = corpus(spark, 3, 200)
    a = InvertedIndex.open(chunks, f"{tmp_path}/i")
    b = InvertedIndex.open(chunks.limit(0), f"{tmp_path}/i")
    assert b.stats == a.stats and b.search(queries, 3)[0].count() == a.search(queries, 3)[0].count()
    empty = InvertedIndex.build(chunks.limit(0), f"{tmp_path}/e")
    assert empty.search(queries, 3)[0].collect() == []


def test_vector_index_finds_most_neighbours_and_reads_few_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 16))
    x = centers[rng.integers(60, size=6000)] + 0.35 * rng.normal(size=(6000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = VectorIndex.build(vectors, f"{tmp_path}/v", sample=2000)
    assert index.manifest["lists"] == 78 and index.lists.count() == len(rows)
    queries = vectors.where("chunk_id % 100 = 0 AND chunk_id < 6000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = retrieval.vector_search(queries, vectors.where("chunk_id < 6000"), 10)
    score = {r.query_id: r.recall for r in vector_index.recall(index.search(queries, 10, 8), exact).collect()}
    read = {r.query_id: r.read / r.of for r in index.read(queries, 8).collect()}
    assert len(score) == 60 and sum(score.values()) / 60 >= 0.9 and sum(read.values()) / 60 < 0.25
    assert index.calibrated(10, 0.9, tries=50) <= 8 and index.calibrated(10, 1.0, tries=50) >= index.calibrated(10, 0.5, tries=50)
    # all lists give the exact ranks
    whole = {(r.query_id, r.rank, r.chunk_id) for r in index.search(queries, 10, 78).where("chunk_id < 6000").collect()}
    assert whole == {(r.query_id, r.rank, r.chunk_id) for r in exact.collect()}
    again = VectorIndex.open(vectors.limit(0), f"{tmp_path}/v")
    assert again.manifest == index.manifest and (again.centroids == index.centroids).all()


def test_recall_of_the_query(spark, sf_dir):
    from clausemill.plans.catalog import QUERIES

    rows = QUERIES["vector_index_recall"](spark, sf_dir).collect()
    assert rows and sum(r.recall for r in rows) / len(rows) >= 0.9 and sum(r.share_read for r in rows) / len(rows) < 0.95


def test_relevance_of_short_and_long_answers(spark):
    chunks = [(1, 0, "The fee is forty two euros a month and it may rise."), (2, 0, "Twofortyfied text"), (3, 0, "a b"), (4, 1, "the fee is forty two euros"), (5, 0, None), (6, 0, "is  FORTY two")]
    answers = [(1, 0, "forty two"), (2, 0, "Forty"), (3, 0, "b"), (4, 0, "The fee is forty two euros a month"), (5, 0, ""), (6, 0, None), (7, 0, "y tw"), (8, 1, "forty two")]
    c = spark.createDataFrame(chunks, "chunk_id long, contract long, text string")
    a = spark.createDataFrame(answers, "query_id long, contract long, answer string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.relevance(a, c, "contract").collect()}
    from clausemill.functions import text as T

    crossed = a.join(c, "contract").where(T.contains_text(F.col("answer"), F.col("text"), 6)).where("answer != ''")
    assert got == {(r.query_id, r.chunk_id) for r in crossed.collect()} and {(1, 1), (1, 6), (2, 2), (4, 1), (8, 4)} <= got
    plan = retrieval.relevance(a, c, "contract")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_stratum_is_cut_over_many_tasks(spark):
    from clausemill.operators import splits

    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("row_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    out = splits.stratified_split(rows, "k")
    counts = {(r.k, r.split): r["count"] for r in out.groupBy("k", "split").count().collect()}
    assert counts == {("rare", "test"): 40, ("rare", "validation"): 40, ("rare", "train"): 320, ("often", "test"): 3960, ("often", "validation"): 3960, ("often", "train"): 31680}
    batches = __import__("clausemill.operators.scoring", fromlist=["batches"]).batches(rows, 7, "k", "row_id")
    sizes = {r["count"] for r in batches.groupBy("k", "batch").count().collect()}
    assert max(sizes) == 7 and batches.count() == 40_000
    sample = splits.stratified_sample(rows, "k", 10)
    assert sample.count() == 10 and sample.select("k").distinct().count() == 2 and sample.columns == rows.columns


def test_the_index_is_searched_without_joins(spark, tmp_path):
    chunks, queries = corpus(spark, 11, 300)
    index = InvertedIndex.build(chunks.repartition(3), f"{tmp_path}/i", span=16)
    found, _ = index.search(queries.unionByName(spark.createDataFrame([(None, "w0"), (15, "w1"), (15, "w1 w2")], "query_id long, query string")), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # neither queries with blocks nor lists with their chunks are rows
    assert index.lists.count() == -(-302 // 16)  # a block is one row
    want = retrieval.bm25(queries.unionByName(spark.createDataFrame([(15, "w1 w1 w2")], queries.schema)), chunks, 5)
    assert {(r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in found.collect()} == {(r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in want.collect()}


@pytest.mark.parametrize("name", ["bm25_index_topk", "bm25_topk"])
def test_scores_are_rounded_as_in_the_sql(spark, tmp_path, name):
    from __spark_entry__ import oracle_sql, queries

    r = random.Random(22)  # one score is 4.1249365, no half in binary
    text = lambda *n: " ".join(r.choice("abcdef") for _ in range(r.randint(*n)))
    for table, key, texts in (("documents", "doc_id", [text(3, 12) for _ in range(12)]), ("benchmark", "item_id", [text(1, 9) for _ in range(8)])):
        spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, chunk_id, rank, score FROM ({oracle_sql()[name]})").fetchall()
    got = [tuple(x) for x in queries()[name](spark, str(tmp_path)).select("query_id", "chunk_id", "rank", "score").collect()]
    assert sorted(got) == sorted(want) and 4.124936 in {x[3] for x in want}


def test_copies_score_the_same_wherever_a_sum_is_cut(monkeypatch):
    from clausemill.operators import query_sets

    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    lists = query_sets.Lists(words * 3, [q for q in range(3) for _ in words], [r.random() for _ in range(120)], 3)
    x = np.tile([r.random() for _ in words], 6)
    row, term = np.repeat(np.arange(6), 40), np.tile(np.arange(40), 6)
    whole = lists.summed(row, term, x, 6)
    monkeypatch.setattr(query_sets, "TERMS", 100)
    assert (lists.summed(row, term, x, 6) == whole).all() and (whole == whole[0]).all()
