"""Two linear heads over embeddings, trained on the masked joint loss; checkpoints to resume from, and exports.

Topics are sigmoids under a mask, risk is a softmax of three classes under a mask of its own. The loss is the masked
mean of the first plus that of the second; ``heads`` keeps one of them. A step sums gradients over all rows: each task
adds up its own in one matrix, the engine sums the matrices by cell, and what comes to the driver is one model's size,
whatever the rows. After each epoch the weights, the optimiser's state and the best epoch so far are written; a run that
finds them goes on where they end, with the same result as one that was never broken. It stops when the validation loss
has not fallen for ``patience`` epochs, and the best epoch is the model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import exists

RISKS = 3


def loss_and_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, risk: np.ndarray, risk_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, topic gradient, risk gradient) of rows, not divided yet: sums are topic loss, mask, risk loss, risk mask.

    ``w`` has a row for each component and one for the bias; topics are its first columns, risks the last three.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    z = x @ w
    topics = y.shape[1]
    a, b = z[:, :topics], z[:, topics:]
    bce = np.maximum(a, 0) - a * y + np.log1p(np.exp(-np.abs(a)))
    sigmoid = np.where(a >= 0, 1 / (1 + np.exp(-np.abs(a))), np.exp(-np.abs(a)) / (1 + np.exp(-np.abs(a))))
    top = b.max(axis=1, keepdims=True)
    e = np.exp(b - top)
    p = e / e.sum(axis=1, keepdims=True)
    own = np.maximum(risk, 0)
    ce = np.log(e.sum(axis=1)) + top[:, 0] - b[np.arange(len(b)), own]
    p[np.arange(len(p)), own] -= 1
    sums = np.array([(bce * mask).sum(), mask.sum(), (ce * risk_mask).sum(), risk_mask.sum()])
    return sums, x.T @ ((sigmoid - y) * mask), x.T @ (p * risk_mask[:, None])


def _summed(shared, topics: int):
    """(cell, value) of a task's rows: the four sums, then the gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros(4 + w.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, mask = (np.array(batch.column(i).to_pylist(), dtype=float) for i in range(3))
            risk, risk_mask = batch.column(3).to_numpy(zero_copy_only=False).astype(int), batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            sums, ga, gb = loss_and_gradient(w, x, y.reshape(-1, topics), mask.reshape(-1, topics), risk, risk_mask)
            total += np.concatenate([sums, np.hstack([ga, gb]).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    return run


def joint(rows: DataFrame, w: np.ndarray, heads: str = "dual") -> tuple[float, np.ndarray]:
    """The loss over all rows (x, labels, mask, risk, risk_mask) and its gradient."""
    topics = w.shape[1] - RISKS
    shared = rows.sparkSession.sparkContext.broadcast(w)
    told = rows.select("x", "labels", "mask", F.coalesce("risk", F.lit(-1)).alias("risk"), F.coalesce("risk_mask", F.lit(0.0)).alias("risk_mask"))
    cells = told.mapInArrow(_summed(shared, topics), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    shared.destroy()
    total = np.zeros(4 + w.size)
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    gradient = total[4:].reshape(w.shape)
    loss = 0.0
    for kind, at, columns in (("topic", 0, slice(0, topics)), ("risk", 2, slice(topics, None))):
        if heads in ("dual", kind):
            n = max(total[at + 1], 1.0)
            loss += total[at] / n
            gradient[:, columns] /= n
        else:
            gradient[:, columns] = 0.0
    return float(loss), gradient


@dataclass
class State:
    """What a run needs to go on: weights, Adam's moments, the best weights and their loss, and the losses so far."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    best: np.ndarray
    best_loss: float
    losses: list[tuple[int, float, float]]

    @property
    def epoch(self) -> int:
        return len(self.losses)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = [a.ravel().tolist() for a in (self.w, self.m, self.v, self.best)]
        row = (*arrays, list(self.w.shape), self.best_loss, json.dumps(self.losses))
        spark.createDataFrame([row], "w array<double>, m array<double>, v array<double>, best array<double>, shape array<int>, best_loss double, losses string").write.mode("overwrite").parquet(f"{path}/epoch={self.epoch}")

    @staticmethod
    def last(spark: SparkSession, path: str, most: int) -> State | None:
        """The state of the last epoch that was written whole."""
        for k in range(most, 0, -1):
            if exists(spark, f"{path}/epoch={k}/_SUCCESS"):
                r = spark.read.parquet(f"{path}/epoch={k}").first()
                arrays = [np.array(a).reshape(r["shape"]) for a in (r.w, r.m, r.v, r.best)]
                return State(*arrays, r.best_loss, [tuple(x) for x in json.loads(r.losses)])
        return None


def train(rows: DataFrame, topics: int, path: str, heads: str = "dual", epochs: int = 20, rate: float = 0.05, decay: float = 0.01, patience: int = 3, seed: int = 42) -> State:
    """The state after training on rows whose ``split`` is train, watched on those whose split is validation."""
    if heads not in ("dual", "topic", "risk"):
        raise ValueError(f"heads must be dual, topic or risk: {heads}")
    spark = rows.sparkSession
    own, watched = rows.where("split = 'train'"), rows.where("split = 'validation'")
    state = State.last(spark, path, epochs)
    if state is None:
        first = rows.select(F.size("x").alias("n")).first()
        w = np.random.default_rng(seed).normal(scale=0.01, size=((first.n if first else 0) + 1, topics + RISKS))
        state = State(w, np.zeros_like(w), np.zeros_like(w), w.copy(), float("inf"), [])
    while state.epoch < epochs:
        at = min(state.losses, key=lambda x: x[2])[0] if state.losses else 0
        if state.epoch - at >= patience and state.losses:
            break
        loss, g = joint(own, state.w, heads)
        k = state.epoch + 1
        state.m, state.v = 0.9 * state.m + 0.1 * g, 0.999 * state.v + 0.001 * g * g
        step = (state.m / (1 - 0.9**k)) / (np.sqrt(state.v / (1 - 0.999**k)) + 1e-8)
        state.w = state.w - rate * (step + decay * state.w)
        seen, _ = joint(watched, state.w, heads)
        if seen < state.best_loss:
            state.best, state.best_loss = state.w.copy(), seen
        state.losses.append((k, loss, seen))
        state.save(spark, path)
    return state


def export(spark: SparkSession, state: State, path: str, meta: dict) -> int | None:
    """Writes a version of the best weights with a manifest of digests, which comes last; None where a better one is there.

    Versions are numbered; an export that breaks off has no manifest and is not read, so the version before stays.
    """
    now = latest(spark, path)
    if now and now["best_loss"] <= state.best_loss:
        return None
    k = (now["version"] if now else 0) + 1
    at = f"{path}/version={k}"
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(state.best)], "row int, weights array<double>").write.mode("overwrite").parquet(f"{at}/weights")
    digest = hashlib.sha256(np.ascontiguousarray(state.best).tobytes()).hexdigest()
    manifest = json.dumps(meta | {"version": k, "best_loss": state.best_loss, "sha256": {"weights": digest}})
    spark.createDataFrame([(manifest,)], "manifest string").write.mode("overwrite").parquet(f"{at}/manifest")
    return k


def latest(spark: SparkSession, path: str, most: int = 10_000) -> dict | None:
    """The manifest of the last whole version."""
    k = 0
    while k < most and exists(spark, f"{path}/version={k + 1}/manifest/_SUCCESS"):
        k += 1
    return json.loads(spark.read.parquet(f"{path}/version={k}/manifest").first()["manifest"]) if k else None


def load(spark: SparkSession, path: str) -> tuple[np.ndarray, dict]:
    """The weights of the last whole version, held against their digest, and its manifest."""
    told = latest(spark, path)
    if told is None:
        raise FileNotFoundError(f"no whole version under {path}")
    w = np.array([r.weights for r in spark.read.parquet(f"{path}/version={told['version']}/weights").orderBy("row").collect()])
    if hashlib.sha256(np.ascontiguousarray(w).tobytes()).hexdigest() != told["sha256"]["weights"]:
        raise ValueError(f"version {told['version']} under {path} is not what its manifest says")
    return w, told
