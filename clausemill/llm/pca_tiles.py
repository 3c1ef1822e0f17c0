"""Near duplicates of vectors by cosine, compared in tiles along principal axes.

Equal vectors of one label are one node. All vectors are turned to the principal axes of all nodes of their length
(second moments summed by the engine), which changes no product, and scaled to length one; two of them reach the
cosine only if they lie within ``reach`` of each other.

Tiles. A label with no more nodes than a unit holds is one unit. Others are cut into cells as wide as ``reach`` along
their first axes, the more axes the larger the label; a node is compared in its own cell and in those next to it that
are within reach of it. A cell with more nodes than a unit holds is dealt into chunks by hash, each pair of chunks is a
unit. So a unit's size has a bound, and nothing is compared twice.

Inside a unit both sides are split into tiles by their widest axis. Two tiles whose boxes along the leading axes lie
apart are left out; two that are so close as wholes that every pair must reach the cosine are linked as wholes.
Otherwise products over the leading axes are summed first; the rest of a product is at most the product of the norms
of what is left of both vectors, and a pair stops where that cannot reach the cosine. What is left is compared on the
vectors themselves, in double precision. A unit tells for each node how many vectors it links with and one node of its
part, so no list of pairs leaves it.

Defined results for odd input: a null label, a null, empty or zero vector, or one with a null or non-finite
component links with nothing and is its own component; vectors of different lengths never link; each row is a vector,
so rows with one id, or equal rows, count as several; a null id is told, counts as a link, and names a component only
if no other id is in it; components are scaled by the largest before norms are taken, so none overflows; an empty table
gives an empty table; other columns are ignored. The principal axes of vectors with d components take d * (d + 1) / 2
sums to the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import picked
from clausemill.llm.components import components
from clausemill.llm.store import Store

#: Nodes of a unit's side, nodes of a tile, axes that cells are cut along at most, axes of boxes, and where sums stop.
UNIT, TILE, CELL_AXES, BOX_AXES, CUTS = 2048, 256, 3, 8, (8, 16, 32)
#: What rounding may take away from a bound, which only makes it keep more pairs.
SLACK = 1e-9


def _vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    """The vectors of a column in double precision; None for those that link with nothing."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.tolist(), strict=True):
        v = values[a:b]
        out.append(v + 0.0 if ok and b > a and np.isfinite(v).all() and v.any() else None)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding, dim, high, low): the halves of a vector's digest; nulls where it links with nothing."""
    for batch in batches:
        found = [v if label else None for v, label in zip(_vectors(batch.column(2)), batch.column(1).is_valid().to_pylist(), strict=True)]
        digests = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found]
        halves = [pa.array([None if d is None else int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8)]
        dim = pa.array([None if v is None else len(v) for v in found], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, dim, *halves], names=[*batch.schema.names, "dim", "high", "low"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, value): a task's sums of products of components (j >= i), of components (j = -1) and of ones (i = -1)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for v in _vectors(batch.column(0)):
            if v is not None:
                by.setdefault(len(v), []).append(v)
        for d, own in by.items():
            x = np.hstack([scaled(np.array(own)), np.ones((len(own), 1))])
            sums[d] = sums.get(d, 0.0) + x.T @ x
    for d, m in sums.items():
        i, j = np.triu_indices(d + 1)
        i, j = np.where(i == d, -1, i), np.where(j == d, -1, j)
        m = m[np.triu_indices(d + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m)], names=["dim", "i", "j", "value"])


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the axes, as columns, by falling variance."""
    summed = nodes.select("embedding").mapInArrow(_moments, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    out = {}
    for d, own in summed.toPandas().groupby("dim"):
        m = np.zeros((d + 1, d + 1))
        i, j = own["i"].to_numpy(), own["j"].to_numpy()
        m[i, j] = m[j, i] = own["value"].to_numpy()
        n, mean = m[d, d], m[:d, d] / m[d, d]
        _, axes = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
        out[int(d)] = np.ascontiguousarray(axes[:, ::-1])
    return out


def _placed(axes, names: list[str]):
    """Adds ``at``: the place of each node along the first axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(scaled(v[None, :]) @ axes.value[len(v)][:, :CELL_AXES])[0].tolist() for v in _vectors(batch.column(names.index("embedding")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.float64()))], names=[*names, "at"])

    return run


def tiles_of(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in tiles of at most ``size``, by halves along the widest axis."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        part = x[own]
        k = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order, half = np.argpartition(part[:, k], len(own) // 2), len(own) // 2
        todo += [own[order[:half]], own[order[half:]]]
    return out


class _Side:
    """One side of a unit: vectors turned to the axes, what is left of their norms after each cut, and tiles."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, cuts: list[int]):
        self.unit = scaled(raw)
        self.turned = self.unit @ axes
        left = np.sqrt(np.cumsum(self.turned[:, ::-1] ** 2, axis=1))[:, ::-1]
        self.left = np.stack([left[:, c] if c < raw.shape[1] else np.zeros(len(raw)) for c in cuts], axis=1)
        self.tiles = tiles_of(self.turned[:, :BOX_AXES], TILE)
        lead = [self.turned[t, :BOX_AXES] for t in self.tiles]
        self.low, self.high = np.array([x.min(axis=0) for x in lead]), np.array([x.max(axis=0) for x in lead])
        means = np.array([self.unit[t].mean(axis=0) for t in self.tiles])
        norms = np.linalg.norm(means, axis=1, keepdims=True)
        self.center = np.where(norms > 1e-6, means / np.maximum(norms, 1e-6), 0.0)
        self.radius = np.array([np.arccos(np.clip((self.unit[t] @ c).min(), -1, 1)) for t, c in zip(self.tiles, self.center, strict=True)])


def linked(a: _Side, b: _Side, cosine: float, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of a, rows of b, whole): pairs that reach the cosine; ``whole`` where all rows of the one link with all of the other.

    With ``a is b`` every pair is told once, and none of a row with itself.
    """
    reach2, angle = 2 - 2 * cosine + SLACK, math.acos(cosine) - 1e-7
    for k, t in enumerate(a.tiles):
        first = k if a is b else 0
        gap = np.maximum(0.0, np.maximum(a.low[k] - b.high[first:], b.low[first:] - a.high[k]))
        near = np.arcsin(np.clip(np.linalg.norm(a.center[k] - b.center[first:], axis=1) / 2, 0, 1)) * 2
        for m in (np.flatnonzero((gap**2).sum(axis=1) <= reach2) + first).tolist():
            u = b.tiles[m]
            same = a is b and m == k
            if near[m - first] + a.radius[k] + b.radius[m] <= angle:
                yield t, u, True
                continue
            total = a.turned[t, : cuts[0]] @ b.turned[u, : cuts[0]].T
            i, j = np.nonzero(total + np.outer(a.left[t, 0], b.left[u, 0]) >= cosine - SLACK)
            if same:
                i, j = i[i < j], j[i < j]
            total = total[i, j]
            i, j = t[i], u[j]
            for n in range(1, len(cuts)):
                if not len(i):
                    break
                total = total + np.einsum("ij,ij->i", a.turned[i, cuts[n - 1] : cuts[n]], b.turned[j, cuts[n - 1] : cuts[n]])
                keep = total + a.left[i, n] * b.left[j, n] >= cosine - SLACK
                i, j, total = i[keep], j[keep], total[keep]
            if len(i):
                exact = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= cosine
                if exact.any():
                    yield i[exact], j[exact], False


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = "id long, links long, root long"


def _compared(axes, cosine: float):
    """What a unit's nodes link with in it: (id, number of vectors, a node of their part)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        ids, weights = table.column("id").to_numpy(), table.column("n").to_numpy()
        column = table.column("embedding").chunk(0) if table.num_rows else None
        raw = np.array(_vectors(column)) if column is not None else np.empty((0, 1))
        d = raw.shape[1]
        cuts = [*[c for c in CUTS if c < d], d]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
        counts, edges = np.zeros(len(ids), dtype=np.int64), []
        if len(left) and (len(right) or not (side == 1).any()):
            a = _Side(raw[left], axes.value[d], cuts)
            b, other = (_Side(raw[right], axes.value[d], cuts), right) if len(right) else (a, left)
            for i, j, whole in linked(a, b, cosine, cuts):
                i, j = left[i], other[j]
                if whole:
                    if len(i) == len(j) and (i == j).all():  # a tile with itself
                        counts[i] += weights[i].sum() - weights[i]
                    else:
                        counts[i] += weights[j].sum()
                        counts[j] += weights[i].sum()
                    i, j = np.append(i, np.full(len(j), i[0])), np.append(np.full(len(i), j[0]), j)
                else:
                    np.add.at(counts, i, weights[j])
                    np.add.at(counts, j, weights[i])
                edges.append((i, j))
        if not edges:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        root = _least(len(ids), *(np.concatenate(x) for x in zip(*edges, strict=True)))
        has = counts > 0
        return pa.table({"id": ids[has], "links": counts[has], "root": ids[root[has]]})

    return run


def _cell(at: Column, axes: Column, width: float) -> Column:
    return F.transform(F.slice(at, 1, axes), lambda x: F.floor(x / width).cast("int"))


def _neighbours(axes: Column) -> Column:
    """The steps to a cell and to those around it, for 0 to ``CELL_AXES`` axes."""
    out = F.expr("array(cast(array() as array<int>))")
    for g in range(1, CELL_AXES + 1):
        steps = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=g)])
        out = F.when(axes == g, steps).otherwise(out)
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", unit: int = UNIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many others it links with, and the least id it reaches."""
    if not 0 < cosine < 1:
        raise ValueError(f"cosine must lie between 0 and 1: {cosine}")
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "vectors")
    own = picked(vectors, vec_id=vec_id, label=label, embedding=embedding).withColumn("vec_id", F.col("vec_id").cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    named = own.mapInArrow(_named, f"{kinds}, dim int, high long, low long")
    key = ["label", "dim", "high", "low"]
    nodes = named.where("high IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    nodes = store.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    axes = spark.sparkContext.broadcast(principal_axes(nodes))

    width = math.sqrt(2 - 2 * cosine) * (1 + SLACK) + SLACK
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    wanted = F.ceil(F.log(F.col("size") / F.lit(float(unit))) / math.log(2.5)).cast("int")
    sizes = sizes.select("label", "dim", F.when(F.col("size") <= unit, 0).otherwise(F.least(F.greatest(wanted, F.lit(1)), F.lit(CELL_AXES), F.col("dim"))).alias("axes"))
    plain = nodes.select("id", "label", "dim", "n", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    placed = plain.mapInArrow(_placed(axes, plain.columns), f"{kinds}, at array<double>").join(sizes, ["label", "dim"]).withColumn("cell", _cell(F.col("at"), F.col("axes"), width))
    chunks = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(unit)).cast("int").alias("chunks"))
    chunks = store.save(chunks, "chunks")

    # a node goes to its own cell and to those around it that its reach touches
    away = lambda x, c, s: F.when(s > 0, (c + 1) * F.lit(width) - x).when(s < 0, x - c * F.lit(width)).otherwise(0.0)
    gaps = F.zip_with(F.zip_with(F.slice("at", 1, F.col("axes")), "cell", lambda x, c: F.struct(x.alias("x"), c.alias("c"))), "step", lambda p, s: away(p["x"], p["c"], s))
    touched = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g) <= width * width * (1 + SLACK) + SLACK
    reached = placed.select("*", F.explode(_neighbours(F.col("axes"))).alias("step")).where(touched)
    reached = reached.withColumn("other", F.zip_with("cell", "step", lambda c, s: c + s)).drop("at", "axes", "step")
    reached = reached.join(chunks.withColumnsRenamed({"cell": "other", "chunks": "theirs"}), ["label", "dim", "other"]).join(chunks, ["label", "dim", "cell"])
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("mine")
    # a unit is the pair of a lesser and a greater (cell, chunk); side 0 is a chunk with itself
    place = lambda cell, chunk: F.struct(cell.alias("cell"), chunk.alias("chunk"))
    each = reached.select("*", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("k"))
    ours, others = place(F.col("cell"), F.col("mine")), place(F.col("other"), F.col("k"))
    dealt = each.select(
        "id", "n", "embedding", "label", "dim", F.least(ours, others).alias("low"), F.greatest(ours, others).alias("high"), F.when(ours == others, 0).when(ours < others, 1).otherwise(2).alias("side")
    )
    found = store.save(dealt.groupBy("label", "dim", "low", "high").applyInArrow(_compared(axes, cosine), _LINKS), "found")

    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), store, "components").withColumnsRenamed({"node": "id"})
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = nodes.select("id", *key, "n", "least").join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    told = store.save(told, "told")
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("there"))
    store.keep("told")
    out = named.select("vec_id", *key).join(told, key, "left")
    component = F.when(F.col("there"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
