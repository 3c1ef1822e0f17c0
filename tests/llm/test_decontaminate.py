import random

import pytest

from clausemill.llm.decontaminate import decontaminate, find_matches, split_words
from clausemill.llm.oracles import ORACLES
from clausemill.llm.query_decontaminate import op8_decontamination
from tests.oracle import compare, connect

DOC = "doc_id long, text string, n_words string, lang string"
ITEM = "item_id long, text string"


def brute(text, items, window):
    words, hits, ids = split_words(text), set(), set()
    for item, t in items:
        own = split_words(t)
        size = min(window, len(own))
        for s in range(len(own) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[s : s + size]:
                    hits.update(range(p, p + size))
                    ids.add(item)
    return len(words), len(hits), ids


@pytest.mark.parametrize("shard_words,block_words", [(40, 10**6), (10**6, 30)])
def test_against_brute_force(spark, shard_words, block_words):
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["a", "B", "c3", "É", "dd", "x-y"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 4, 5, 9, 12]))) for i in range(12)] + [(99, None), (3, "a a a a a a")]
    docs = [(i, text(r.randint(0, 60)) + " " + (r.choice(items)[1] or ""), "n", "x") for i in range(60)]
    docs += [(None, None, "n", "x"), (7, "", "n", "x"), docs[0], docs[0], (8, "a " * 500, "n", "x")]
    got = find_matches(spark.createDataFrame(docs, DOC).coalesce(2), spark.createDataFrame(items, ITEM), window=4, shard_words=shard_words, block_words=block_words, with_matches=True)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "item_ids", "matches"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for row in rows:
        n, hit, ids = brute(row.text, items, 4)
        assert (row.n_words, row.n_hit, {m.item_id for m in row.matches}) == (n, hit, ids)
        assert len(row.item_ids) == len(ids) and set(row.item_ids) == ids
        words = split_words(row.text)
        for m in row.matches:
            assert any(
                i == m.item_id and split_words(t)[m.item_start : m.item_start + m.n_words] == words[m.doc_start : m.doc_start + m.n_words] for i, t in items
            )


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five z one two")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "zero one two three four five six")], ITEM)
    row = find_matches(docs, items, window=3, with_matches=True).first()
    assert [tuple(m) for m in row.matches] == [(5, 1, 2, 5)] and row.n_hit == 5
    assert decontaminate(docs, items, window=3).count() == 0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], ITEM)
    assert find_matches(docs, items).first().n_hit == 0
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], ITEM)).collect() == []


def test_items_without_an_id(spark, tmp_path):
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    items = [(1, text(1, 12)), (None, text(2, 12)), (None, "x y " + text(3, 14)), (None, None), (1, text(4, 11)), (None, text(1, 12))]
    docs = [(1, "a " + text(2, 12) + " b"), (2, text(3, 14) + " " + text(2, 11)), (3, text(1, 12)), (4, text(4, 11) + " " + text(3, 10)), (5, "none " + text(3, 9)), (6, None)]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in op8_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (12, 1, True), 2: (25, 1, True), 3: (12, 2, True), 4: (21, 2, True), 5: (0, 0, False), 6: (0, 0, False)}
    assert compare(op8_decontamination(spark, str(tmp_path)), ORACLES["op8_decontamination"], connect(str(tmp_path))) is None
    found = find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), with_matches=True).where("doc_id = 2").first()
    assert sorted((tuple(m) for m in found.matches), key=str) == [(None, 0, 14, 11), (None, 2, 0, 14)]


def test_only_one_block_is_alive(spark, monkeypatch):
    """Many small blocks: each broadcast is gone before the next, and the plan that is left has one pass over rows."""
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["a", "b", "c", "d"]) for _ in range(n))
    items, docs = [(i, text(9)) for i in range(20)], [(i, text(40), "n", "x") for i in range(30)]
    alive, most = set(), []
    context = type(spark.sparkContext)
    plain = context.broadcast

    def counted(self, value):
        made = plain(self, value)
        alive.add(id(made))
        most.append(len(alive))
        destroy = made.destroy
        made.destroy = lambda *a: (alive.discard(id(made)), destroy(*a))
        return made

    monkeypatch.setattr(context, "broadcast", counted)
    got = find_matches(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM).coalesce(1), window=6, block_words=18)
    assert len(most) == 10 and max(most) == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for row in got.collect():
        n, hit, ids = brute(row.text, items, 6)
        assert (row.n_words, row.n_hit, set(row.item_ids)) == (n, hit, ids)


def test_a_repeated_word_hits_in_linear_space(spark):
    docs = spark.createDataFrame([(1, "z " * 200_000, "n", "x")], DOC)
    row = find_matches(docs, spark.createDataFrame([(1, "z " * 3_000), (2, "z " * 4_000)], ITEM)).first()
    assert (row.n_words, row.n_hit, row.item_ids) == (200_000, 200_000, [1, 2])


def test_bytes_written_do_not_grow_with_blocks(spark, monkeypatch):
    """Documents are written once; a pass writes numbers and finds alone."""
    from clausemill.llm import store

    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["a", "b", "c", "d"]) for _ in range(n))
    items, docs = [(i, text(9)) for i in range(20)], [(i, text(400), "n", "x") for i in range(60)]
    written = []
    plain = store.Store.save

    def noted(self, df, name):
        written.append((name, df.columns))
        return plain(self, df, name)

    monkeypatch.setattr(store.Store, "save", noted)
    many = {}
    for block_words in (18, 60, 10**6):
        written.clear()
        got = find_matches(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), window=6, block_words=block_words, with_matches=True)
        many[block_words] = sorted((x.doc_id, x.n_words, x.n_hit, x.item_ids, sorted(map(tuple, x.matches))) for x in got.collect())
        assert sum("text" in str(columns) or len(columns) > 6 for _, columns in written) == 0
        assert [name for name, columns in written if not name.startswith("block")] == (["docs"] if block_words < 10**6 else [])
    assert many[18] == many[60] == many[10**6] and any(x[2] for x in many[18])
