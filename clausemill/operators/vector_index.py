"""An index of vectors by coarse cells: centroids, lists as a table dealt by centroid, and exact ranking of what is read.

Centroids are fitted by k-means on the sphere over a bounded sample (the ``sample`` vectors with the least seeded hash
of their id, a documented parameter); every vector is then assigned to its nearest one and written in that one's list.
A search reads the lists of the ``probes`` nearest centroids of each query and ranks their vectors by exact cosine. The
number of centroids has a bound, so they are sent to tasks. The manifest is written last and names what was built; an
index that is there is read, not built again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import query_sets
from clausemill.operators.retrieval import top_k, vector_search
from clausemill.session import exists

#: Vectors that centroids are fitted on, at most, centroids at most, and rounds of the fit.
SAMPLE, CENTROIDS, ROUNDS = 50_000, 4096, 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """k directions of unit rows: farthest-first starts among a seeded draw, then means; an empty one takes the worst served row."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        own, served = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(served)[: len(empty)]]
        centers = unit(sums)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, and the cosine."""
    own, served = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for at in range(0, len(x), block):
        dots = x[at : at + block] @ centers.T
        own[at : at + block] = dots.argmax(axis=1)
        served[at : at + block] = dots.max(axis=1)
    return own, served


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array([[float("nan") if c is None else c for c in v] if v is not None and len(v) == dim else [0.0] * dim for v in column.to_pylist()], dtype=float).reshape(-1, dim)


def _of_lists(state: tuple, batch: pa.RecordBatch) -> Iterator[tuple]:
    """The cosines of a batch (chunk_id, embedding, list), each list with the queries that read it."""
    vectors, bits = state
    lists = batch.column(2).to_numpy()
    order = np.argsort(lists, kind="stable")
    values, starts = np.unique(lists[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
        at = pa.array(rows)
        yield from vectors.scores(batch.column(0).take(at), batch.column(1).take(at), np.unpackbits(bits[value], count=vectors.n).astype(bool))


class VectorIndex:
    """The tables of an index under ``path``; see ``build`` and ``open``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.center for r in rows])
        self.lists = spark.read.parquet(f"{path}/lists")

    @staticmethod
    def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 42) -> VectorIndex:
        """Writes the index of (chunk_id, embedding). Null, zero or odd vectors, and those of another length, go into list -1, which every search reads."""
        spark = vectors.sparkSession
        good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double"))) & F.exists("embedding", lambda c: c != 0)
        order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string")))
        drawn = vectors.where(good).select("embedding", order.alias("o")).orderBy("o").limit(sample).select("embedding").collect()
        n = vectors.count()
        dim = len(drawn[0].embedding) if drawn else 1
        x = unit(np.array([r.embedding for r in drawn if len(r.embedding) == dim], dtype=float).reshape(-1, dim))
        k = max(1, min(lists or math.ceil(math.sqrt(n)), CENTROIDS, len(x)))
        centers = kmeans(x, k, seed=seed) if len(x) else np.zeros((1, dim))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        shared = spark.sparkContext.broadcast(centers)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(1), dim)
                odd = ~np.isfinite(m).all(axis=1) | ~m.any(axis=1)
                own, _ = nearest(unit(np.where(odd[:, None], 0.0, m)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(odd, -1, own).astype(np.int32))], names=["chunk_id", "embedding", "list"])

        source = vectors.select("chunk_id", "embedding")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
        told = source.mapInArrow(assign, f"{kinds}, list int")
        # lists lie next to each other in files that are sorted by them, so a read of few lists skips the rest
        told.repartitionByRange("list", "chunk_id").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/lists")
        manifest = json.dumps({"vectors": n, "lists": k, "dim": dim, "sample": len(x), "seed": seed})
        spark.createDataFrame([(manifest,)], "manifest string").write.mode("overwrite").parquet(f"{path}/manifest")
        shared.destroy()
        return VectorIndex(spark, path)

    @staticmethod
    def open(vectors: DataFrame, path: str, **options) -> VectorIndex:
        """The index that is there, else a new one."""
        spark = vectors.sparkSession
        return VectorIndex(spark, path) if exists(spark, f"{path}/manifest/_SUCCESS") else VectorIndex.build(vectors, path, **options)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """The queries (query_id, query_vector), a row for each list that they read."""
        centers, dim = self.spark.sparkContext.broadcast(self.centroids), self.manifest["dim"]
        probes = min(probes, len(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = np.nan_to_num(_matrix(batch.column(1), dim))
                best = np.argsort(-(unit(m) @ centers.value.T), axis=1, kind="stable")[:, :probes]
                lists = [[*row.tolist(), -1] for row in best]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "query_vector", "lists"])

        source = queries.select("query_id", "query_vector")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
        return source.mapInArrow(run, f"{kinds}, lists array<int>").select("query_id", "query_vector", F.explode("lists").alias("list"))

    def calibrated(self, k: int = 10, target: float = 0.95, tries: int = 100, seed: int = 7) -> int:
        """The fewest probes by which ``tries`` vectors of the index, drawn by a seeded hash, find the target share of their k neighbours.

        The draw is a bounded query set, held against all vectors once; what comes to the driver is its neighbours' lists.
        """
        order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string")))
        drawn = self.lists.where("list >= 0").orderBy(order, "chunk_id").limit(tries).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")).collect()
        if not drawn:
            return 1
        queries = self.spark.createDataFrame(drawn, "query_id " + self.lists.schema["chunk_id"].dataType.simpleString() + ", query_vector array<double>")
        near = vector_search(queries, self.lists.where("list >= 0").select("chunk_id", "embedding"), k).join(self.lists.select("chunk_id", "list"), "chunk_id").select("query_id", "list").collect()
        at = {r.query_id: i for i, r in enumerate(drawn)}
        places = np.argsort(np.argsort(-(unit(np.array([r.query_vector for r in drawn], dtype=float)) @ self.centroids.T), axis=1, kind="stable"), axis=1)
        needed = np.sort([places[at[r.query_id], r.list] + 1 for r in near])
        return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, block: int = 10_000) -> DataFrame:
        """(query_id, chunk_id, score, rank) by exact cosine over the lists that the queries probe.

        Queries go to the tasks in blocks of about ``block``, with a bit for each list that a query reads; a task goes over
        its own lists and keeps k rows of each query, so no pair of query and vector is shuffled.
        """
        kind, told = queries.schema["query_id"].dataType.simpleString(), None
        chunk = self.lists.schema["chunk_id"].dataType.simpleString()
        rows = self.lists.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "list")
        source = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), F.lit(1).alias("size"))
        for own in query_sets.blocks(source, "size", block):
            wanted = np.zeros((len(self.centroids) + 1, len(own)), dtype=bool)  # the last one is list -1
            wanted[-1] = True
            vectors = np.nan_to_num(_matrix(pa.array([r.v for r in own], pa.list_(pa.float64())), self.manifest["dim"]))
            for at in range(0, len(own), 1000):
                best = np.argsort(-(unit(vectors[at : at + 1000]) @ self.centroids.T), axis=1, kind="stable")[:, :probes]
                wanted[best.reshape(-1), np.repeat(np.arange(at, at + len(best)), best.shape[1])] = True
            state = (query_sets.Vectors([r.v for r in own]), np.packbits(wanted, axis=1))
            best = query_sets.best_of(rows, [r.query_id for r in own], kind, k, state, _of_lists)
            told = best if told is None else told.unionByName(best)
        if told is None:
            told = self.spark.createDataFrame([], f"query_id {kind}, chunk_id {chunk}, score double")
        return top_k(query_sets.cosines(told), k, "query_id")

    def read(self, queries: DataFrame, probes: int = 8) -> DataFrame:
        """(query_id, read, of): vectors that a query's lists hold, of all."""
        sizes = self.lists.groupBy("list").agg(F.count("*").alias("n"))
        told = self.probed(queries, probes).join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("read"))
        return told.withColumn("of", F.lit(self.manifest["vectors"]))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact neighbours (query_id, chunk_id) that were found."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
