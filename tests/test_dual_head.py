"""The masked joint loss: gradients, training that resumes, early stopping, exports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import dual_head as H


def made(spark, n=400, d=6, topics=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    true = rng.normal(size=(d, topics + 3))
    z = x @ true
    rows = [
        (k, ("train", "train", "train", "validation")[k % 4], x[k].tolist(), (z[k, :topics] > 0).astype(float).tolist(), (rng.random(topics) > 0.3).astype(float).tolist(), int(z[k, topics:].argmax()) if k % 5 else None, float(k % 5 > 0))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "row_id long, split string, x array<double>, labels array<double>, mask array<double>, risk int, risk_mask double").repartition(3)


@pytest.mark.parametrize("heads", ["dual", "topic", "risk"])
def test_gradient_against_differences(spark, heads):
    rows = made(spark, 60, 3, 2)
    w = np.random.default_rng(3).normal(size=(4, 5))
    loss, g = H.joint(rows, w, heads)
    data = rows.collect()
    x, y, m = (np.array([r[c] for r in data]) for c in ("x", "labels", "mask"))
    risk, risk_mask = np.array([-1 if r.risk is None else r.risk for r in data]), np.array([r.risk_mask for r in data])

    def plain(w):
        z = np.hstack([x, np.ones((len(x), 1))]) @ w
        p = 1 / (1 + np.exp(-z[:, :2]))
        topic = -(m * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / max(m.sum(), 1)
        q = np.exp(z[:, 2:]) / np.exp(z[:, 2:]).sum(axis=1, keepdims=True)
        harm = -(risk_mask * np.log(q[np.arange(len(q)), np.maximum(risk, 0)])).sum() / max(risk_mask.sum(), 1)
        return {"dual": topic + harm, "topic": topic, "risk": harm}[heads]

    assert loss == pytest.approx(plain(w))
    for i in range(w.shape[0]):
        for j in range(w.shape[1]):
            up, down = w.copy(), w.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert g[i, j] == pytest.approx((plain(up) - plain(down)) / 2e-6, abs=1e-7)


def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    rows = made(spark).cache()
    whole = H.train(rows, 4, f"{tmp_path}/a", epochs=6, rate=0.2)
    H.train(rows, 4, f"{tmp_path}/b", epochs=3, rate=0.2)
    resumed = H.train(rows, 4, f"{tmp_path}/b", epochs=6, rate=0.2)
    assert whole.epoch == resumed.epoch == 6 and np.allclose(whole.w, resumed.w, atol=1e-9) and np.allclose(whole.best, resumed.best, atol=1e-9)
    assert whole.losses[-1][1] < whole.losses[0][1] < 2.0
    again = H.train(rows.limit(0), 4, f"{tmp_path}/b", epochs=6)
    assert np.allclose(again.w, resumed.w, atol=1e-12)
    with pytest.raises(ValueError, match="heads"):
        H.train(rows, 4, f"{tmp_path}/c", heads="none")


def test_early_stop_keeps_the_best_epoch(spark, tmp_path):
    rows = made(spark, 80)
    # labels of the validation rows turned round: what is learned makes them worse
    turned = rows.withColumn("labels", F.when(F.col("split") == "validation", F.transform("labels", lambda v: 1.0 - v)).otherwise(F.col("labels")))
    state = H.train(turned, 4, f"{tmp_path}/s", heads="topic", epochs=15, rate=0.3, patience=2)
    assert state.epoch < 15 and state.best_loss == min(x[2] for x in state.losses) and state.losses[-1][2] > state.best_loss


def test_exports(spark, tmp_path):
    path = f"{tmp_path}/model"
    state = H.State(*[np.arange(12.0).reshape(3, 4)] * 4, 0.5, [])
    with pytest.raises(FileNotFoundError):
        H.load(spark, path)
    assert H.export(spark, state, path, {"run": "a"}) == 1 and H.export(spark, state, path, {"run": "b"}) is None
    # an export that breaks off before its manifest leaves the old one
    spark.createDataFrame([(0, [1.0])], "row int, weights array<double>").write.parquet(f"{path}/version=2/weights")
    w, told = H.load(spark, path)
    assert told["run"] == "a" and (w == state.best).all()
    state.best_loss = 0.4
    assert H.export(spark, state, path, {"run": "c"}) == 2 and H.load(spark, path)[1]["run"] == "c"
    spark.createDataFrame([(0, [1.0])], "row int, weights array<double>").write.mode("overwrite").parquet(f"{path}/version=2/weights")
    with pytest.raises(ValueError, match="manifest"):
        H.load(spark, path)


def test_query(spark, sf_dir):
    from clausemill.plans.catalog import QUERIES

    rows = sorted(QUERIES["dual_head_training"](spark, sf_dir).collect())
    assert [r.epoch for r in rows] == list(range(1, len(rows) + 1)) and rows[-1].train_loss < rows[0].train_loss < 2.5
