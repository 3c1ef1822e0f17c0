import random

from clausemill.llm.jaccard import keep_one, near_duplicates

SCHEMA = "doc_id long, text string, node string"


def brute(rows, size=5, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [r[0]]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    hot = " ".join(r.choice(vocabulary) for _ in range(30))
    bases = [[r.choice(vocabulary) for _ in range(r.randint(1, 120))] for _ in range(10)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(0, 100))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary).lower()
        rows.append((i * 3 % 1009, " ".join(w) + (" " + hot if r.random() < 0.4 else ""), "x"))
    return rows


def test_against_brute_force(spark):
    for seed, options in ((1, {}), (2, {"hot_least": 4, "hot_share": 0.05, "bucket_tokens": 300}), (3, {"pivots": ()}), (4, {"percent": 50, "size": 2})):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
        want = brute(rows, options.get("size", 5), options.get("percent", 75))
        assert sorted([tuple(r) for r in got], key=str) == want, seed


def test_sets_that_share_a_name(spark):
    rows = corpus(5)
    for bits in (1, 5, 64):
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), name_bits=bits).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute(rows), bits


def test_links_form_chains(spark):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(9):
        rows.append((90 - i, " ".join(words), "x"))
        words[i * 6] = f"new{i}"
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows) and {r.component_id for r in got} == {82}


def test_nulls_ties_repeated_rows_and_empty(spark):
    rows = [(None, None, "x"), (None, "a b c", "x"), (5, "A b  c", "x"), (5, "a b c", "x"), (6, "", "x"), (7, " \n", "x"), (8, "a b c d", "x"), (9, "z " * 3000, "x"), (10, "z " * 9, "x")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = sorted((str(r.doc_id), r.text) for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [k[0] for k in kept] == ["5", "6", "7", "8", "9", "None"] and kept[-1][1] is None


def test_keep_one_with_repeated_ids(spark):
    rows = [(5, "a b c d e f", "x"), (5, "other words that stand alone here", "x"), (3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (None, "a b c d e f", "x")]
    kept = sorted((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [(3, "a b c d e f"), (5, "other words that stand alone here")]


def test_frequent_tokens_do_not_depend_on_batches(monkeypatch):
    """A token in every tenth document is told whatever the size of batches, and with few counters too."""
    import pyarrow as pa

    from clausemill.llm import jaccard

    docs = [f"{' '.join(f'own{i}x{j}' for j in range(12))} {'the hot five words here' if i % 10 == 0 else ''}" for i in range(600)]
    hot = jaccard.shingles("the hot five words here", 5).view("int64")[0]
    told = {}
    for rows in (7, 50, 600):
        for counted in (400, 2_000_000):
            monkeypatch.setattr(jaccard, "_COUNTED", counted)
            batches = [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + rows, 600)), pa.int64()), pa.array(docs[a : a + rows])], names=["doc_id", "text"]) for a in range(0, 600, rows)]
            out = [r for b in jaccard._profile(5, 1 / 4096, 512)(iter(batches)) for r in b.to_pylist() if r["token"] is not None]
            told[rows, counted] = {r["token"]: r["n"] for r in out}
    assert all(hot in found for found in told.values())
    assert {found[hot] for (_, counted), found in told.items() if counted > 400} == {60}
