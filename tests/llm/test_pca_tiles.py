"""Near duplicates of vectors against all pairs: tiles, cells, chunks, copies, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm.pca_tiles import CUTS, _Side, linked, near_vectors, tiles_of


def plain(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs, one per row."""
    ok = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.array(v, dtype=float) if good else None
        ok.append(u / np.abs(u).max() if good else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        r = find(i)
        if v is not None:
            least[r] = min(least.get(r, v), v)
    out = [(v, links[i], least.get(find(i)), v is not None and v == least.get(find(i))) for i, (v, *_) in enumerate(rows)]
    return sorted(out, key=str)


def told(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def made(seed, n, d, groups, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    x = centers[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, d)) * rng.choice([0.2, 1.0, 3.0], size=(n, 1))
    return x.astype(np.float32)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("unit", [2048, 60, 9])
@pytest.mark.parametrize("d", [2, 12, 40])
def test_every_link_and_component(spark, d, unit):
    x = made(d, 260, d, 25, 0.08)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(3, size=len(x)), strict=True))]
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(950 + i, (np.array(rows[1][1]) * 7).tolist(), rows[1][2]) for i in range(5)]
    want = plain([(i, np.float32(v).tolist(), k) for i, v, k in rows])
    assert sum(w[1] for w in want) > 100
    assert told(near_vectors(spark.createDataFrame(rows, SCHEMA), unit=unit)) == want


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (13, [-1.0, 0.0], 0), (14, [-0.0, 1.0], 0), (15, [0.0, 1.0], 0),
        (16, [1e-40, 0.0], 0), (17, [3e38, 1e37], 0), (18, [1.0], 0), (19, [5.0], 0), (20, [-5.0], 0), (None, [0.0, 0.0, 1.0], 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("id"), F.lit("y").alias("N"), F.lit("z").alias("LABEL"), F.lit(1).alias("kept"))
    own = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], k) for i, v, k in rows]
    assert told(near_vectors(df)) == plain(own) and told(near_vectors(df, unit=2)) == plain(own)
    assert near_vectors(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="cosine"):
        near_vectors(df, cosine=1.0)


def test_double_vectors_and_text_labels(spark):
    rows = [(i, v.tolist(), f"l{i % 2}") for i, v in enumerate(made(3, 80, 6, 6, 0.1).astype(float))]
    assert told(near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string"), cosine=0.95)) == plain(rows, 0.95)


def test_tight_groups_are_linked_as_wholes_and_bounds_leave_out_most_pairs():
    rng = np.random.default_rng(8)
    tight = rng.normal(size=(1, 64)) + 0.01 * rng.normal(size=(3000, 64))
    cuts = [*CUTS, 64]
    axes = np.linalg.eigh(np.cov(tight.T))[1][:, ::-1]
    side = _Side(tight, axes, cuts)
    told = list(linked(side, side, 0.98, cuts))
    assert all(whole for *_, whole in told) and len(told) == len(side.tiles) * (len(side.tiles) + 1) // 2
    assert sorted(np.concatenate(tiles_of(tight, 100)).tolist()) == list(range(3000))


def test_query_on_its_table(spark, sf_dir):
    from clausemill.llm.query_vectors import op13_embedding_neardup

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert told(op13_embedding_neardup(spark, sf_dir)) == plain(rows)
