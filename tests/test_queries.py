import math
import struct
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from clausemill.plans.catalog import ORACLES, QUERIES
from clausemill.plans.label_queries import cells
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_an_oracle_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def plain_chunks(text, limit=64):
    """Paragraphs (lines), sentences and greedy packing by loops: (paragraph, text, tokens, cut)."""
    count = lambda t: len(regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", t))
    lines = [t for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if (t := x.strip())]
    for k, line in enumerate(lines):
        if len(line) < 15:
            continue
        parts = [line]
        if count(line) > limit:
            sentences = [t for x in regex.split(r"(?<=[.!?][\"')\]]?)(?<=\S)\s+", line) if (t := x.strip())]
            groups, n = [], 0
            for s in sentences:
                if groups and n + count(s) <= limit:
                    groups[-1].append(s)
                    n += count(s)
                else:
                    groups.append([s])
                    n = count(s)
            parts = [" ".join(g) for g in groups]
        for p in parts:
            yield k, p, count(p), len(parts) > 1


def test_chunks_report_and_restored_paragraphs_against_loops(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(i, k): c for i, t in docs.items() for k, c in enumerate(plain_chunks(t))}
    got = {(r.doc_id, r.chunk_id): (r.paragraph_id, r.text, r.estimated_tokens, r.is_subchunk) for r in QUERIES["document_chunks"](spark, sf_dir).collect()}
    assert got == want and any(c[3] for c in want.values())
    harm = Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect())
    for r in QUERIES["document_report"](spark, sf_dir).collect():
        own = [c for (i, _), c in want.items() if i == r.doc_id]
        lines = [x.strip() for x in docs[r.doc_id].split("\n") if x.strip()]
        assert (r.n_paragraphs, r.n_skipped, r.n_chunks, r.n_tokens) == (len(lines), sum(len(x) < 15 for x in lines), len(own), sum(c[2] for c in own))
        assert r.n_subchunked == len({c[0] for c in own if c[3]}) and (r.harmful_share is None) == (r.doc_id not in harm)
    rows = QUERIES["restored_paragraphs"](spark, sf_dir).collect()
    places = [(r.doc_id, r.paragraph_id, -1 if r.chunk_id is None else r.chunk_id) for r in rows]
    assert places == sorted(places)
    kept = {(r.doc_id, r.chunk_id): (r.paragraph_id, r.estimated_tokens) for r in rows if r.chunk_id is not None}
    assert kept == {key: (c[0], c[2]) for key, c in want.items()}
    assert Counter(i for i, _, c in places if c < 0) == Counter(i for i, t in docs.items() for x in t.split("\n") if 0 < len(x.strip()) < 15)


def test_analysis_scores_every_chunk_once(spark, sf_dir):
    rows = QUERIES["analyzed_documents"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(i, k): c[1] for i, t in docs.items() for k, c in enumerate(plain_chunks(t, 256))}
    assert {(r.doc_id, r.chunk_id): r.text for r in rows} == want and len(rows) == len(want)


def plain_weight(replicate, row_id, seed=42):
    """The Poisson(1) weight of a row in a replicate, from the engine's hash of (seed, replicate, row)."""
    h = 42
    for form, value in (("<i", seed), ("<i", replicate), ("<q", row_id)):
        h = xxhash.xxh64_intdigest(struct.pack(form, value), h)
    u, total, term = (h % 2**53) / 2**53, 0.0, math.exp(-1)
    for k in range(9):
        total += term
        if u < total:
            return k
        term /= k + 1
    return 9


@pytest.fixture(scope="module")
def plain_draws(spark, sf_dir):
    """Macro and micro F1 of both predictions over all cells and over 1,000 weighted replicates."""
    rows = [r for r in cells(spark, sf_dir).collect() if r.mask == 1.0]
    ids = sorted({r.row_id for r in rows})
    place = {i: k for k, i in enumerate(ids)}
    weights = np.array([[1] * len(ids)] + [[plain_weight(b, i) for i in ids] for b in range(1000)], dtype=float)
    out = {}
    for column in ("prediction", "prediction_b"):
        tallies = []
        for topic in sorted({r.topic_index for r in rows}):
            own = np.zeros((3, len(ids)))
            for r in rows:
                if r.topic_index == topic:
                    label, guess = r.label == 1.0, r[column] == 1
                    own[:, place[r.row_id]] = guess and label, guess and not label, label and not guess
            tallies.append(weights @ own.T)
        f1 = lambda c: 2 * c[..., 0] / (2 * c[..., 0] + c[..., 1] + c[..., 2])
        c = np.array(tallies)
        out[column] = f1(c).mean(axis=0), f1(c.sum(axis=0))
    return out


def test_bootstrap_against_plain_draws(spark, sf_dir, plain_draws):
    for row in QUERIES["bootstrap_interval"](spark, sf_dir).collect():
        values = plain_draws["prediction"][("macro_f1", "micro_f1").index(row.metric)]
        want = (values[0], values[1:].mean(), *np.percentile(values[1:], (2.5, 97.5)))
        assert (row.point, row["mean"], row.ci_low, row.ci_high) == pytest.approx(want, abs=1e-12)


def test_paired_bootstrap_against_plain_draws(spark, sf_dir, plain_draws):
    d = plain_draws["prediction"][0] - plain_draws["prediction_b"][0]
    (row,) = QUERIES["paired_bootstrap"](spark, sf_dir).collect()
    assert (row.delta, row.ci_low, row.ci_high, row.replicates) == pytest.approx((d[0], *np.percentile(d[1:], (2.5, 97.5)), 1000), abs=1e-12)
    assert row.p_value == pytest.approx((abs(d[1:] - d[1:].mean()) >= abs(d[0])).mean(), abs=1e-9)


def plain_probe(ids, x, y, penalty=1e-3):
    """Accuracy on the rows whose id 5 divides of a balanced softmax regression, fitted on the others by Newton steps."""
    test = ids % 5 == 0
    x = (x - x[~test].mean(axis=0)) / x[~test].std(axis=0, ddof=1)
    x = np.hstack([x, np.ones((len(x), 1))])
    names, k = np.unique(y[~test], return_inverse=True)
    a, n, d = x[~test], len(names), x.shape[1]
    w = (1 / np.bincount(k))[k] / n
    ridge = np.tile(np.r_[np.full(d - 1, penalty), 1e-9], n)
    b = np.zeros((n, d))
    for _ in range(30):
        z = a @ b.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (((p - np.eye(n)[k]) * w[:, None]).T @ a).ravel() + ridge * b.ravel()
        hess = np.block([[(a * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a for j in range(n)] for i in range(n)]) + np.diag(ridge)
        b -= np.linalg.solve(hess, grad).reshape(n, d)
    return (names[(x[test] @ b.T).argmax(axis=1)] == y[test]).mean(), test.sum()


def test_probes_against_newton_steps(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lengths = read("documents").join(read("labels"), "doc_id").select("doc_id", "n_chars", "quality").collect()
    vectors = read("embeddings").select("vec_id", "embedding", "label").collect()
    for name, rows, x in (("length_probe", lengths, [[r.n_chars] for r in lengths]), ("embedding_probe", vectors, [r.embedding for r in vectors])):
        accuracy, n = plain_probe(np.array([r[0] for r in rows]), np.array(x, dtype=float), np.array([r[2] for r in rows]))
        (row,) = QUERIES[name](spark, sf_dir).collect()
        assert row.valid_rows == n and row.accuracy == pytest.approx(accuracy, abs=0.02)
