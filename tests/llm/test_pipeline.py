import random

import corpus_pipeline
from clausemill.llm.decontaminate import split_words
from tests.llm.test_jaccard import brute as brute_jaccard
from tests.llm.test_line_dedup import brute as brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    para = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [para(30) for _ in range(4)]
    passage = para(60)
    rows = [(i, "\n".join(para(r.randint(10, 40)) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(110 + i, rows[i + 5][1].replace(rows[i + 5][1].split()[20], "changed", 1) + f"\nEnd {i}.") for i in range(5)]
    rows += [(120 + i, rows[i + 12][1] + "\n" + passage) for i in range(4)]
    rows += [(130 + i, para(20) + "\n" + items[i] + " " + para(5)) for i in range(4)]
    rows += [(140, " ".join(word().upper() + "!!" for _ in range(60))), (141, "too short."), (142, ""), (143, None), (144, " | ".join(word() for _ in range(50)))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], items


def stage(spark, tmp_path, k, rows):
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, SCHEMA).repartition(2), str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(tuple(r) for r in out.collect())


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = stage(spark, tmp_path, 0, rows)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {140, 141, 142, 143, 144}
    assert {r[0]: r[1] for r in kept} == {r[0]: r[1] for r in rows if r[0] < 140}

    lines = stage(spark, tmp_path, 1, kept)
    want = [(i, t) for i, t, gone in brute_lines([(r[0], r[1]) for r in kept], 50) if not gone or t.split()]
    assert [(r[0], r[1]) for r in lines] == sorted(want) and all(r[4] == len(r[1]) for r in lines)
    assert not {r[0] for r in lines} & set(range(100, 105))

    single = stage(spark, tmp_path, 2, lines)
    named = brute_jaccard([(r[0], r[1]) for r in lines])
    assert [r[0] for r in single] == sorted(i for i, _, c in named if i == c)

    clean = stage(spark, tmp_path, 3, single)
    windows = {tuple(w[s : s + 10]) for t in items for w in [split_words(t)] for s in range(len(w) - 9)}
    leaks = lambda t: any(tuple(w[p : p + 10]) in windows for w in [split_words(t)] for p in range(len(w) - 9))
    assert clean == [r for r in single if not leaks(r[1])] and not {r[0] for r in clean} & {130, 131, 132, 133}

    packed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(clean, SCHEMA), str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in clean}


def test_run_is_the_stages_in_order(spark, tmp_path):
    rows, items = corpus(6)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for k in range(4):
        rows = stage(spark, tmp_path, k, rows)
    assert got == {r[0] for r in rows} and len(got) > 30


def test_stages_that_are_not_written_between_keep_what_they_read(spark, tmp_path):
    """Stage on stage without writing, and another input's stage between: nothing that is still read goes away."""
    rows, items = corpus(9)
    for name in ("a", "b"):
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    lazy = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    lazy = corpus_pipeline.STAGES[1][1](spark, lazy, f"{tmp_path}/a")
    corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/b").count()
    lazy = corpus_pipeline.STAGES[2][1](spark, lazy, f"{tmp_path}/a")
    lazy = corpus_pipeline.STAGES[3][1](spark, lazy, f"{tmp_path}/a")
    got = sorted(tuple(r) for r in lazy.collect())
    for k in range(4):
        rows = stage(spark, tmp_path / "b", k, rows)
    assert got == rows


def packed_ids(rows, whole):
    """doc_id to the token ids that its text must have."""
    return {r[0]: [*whole.encode(r[1], add_special_tokens=False).ids, 0] for r in rows}


def test_run_against_a_plain_pipeline(spark, tmp_path):
    """The packed ids of run() against one made of the brute-force versions of every stage."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, items = corpus(10)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r[0], r[1]) for r in rows if r[0] < 140]  # the corpus says which documents the rules must reject
    kept = [(i, t) for i, t, gone in brute_lines(kept, 50) if not gone or t.split()]
    named = {i: c for i, _, c in brute_jaccard(kept)}
    kept = [(i, t) for i, t in kept if named[i] == i]
    windows = {tuple(w[s : s + 10]) for t in items for w in [split_words(t)] for s in range(len(w) - 9)}
    kept = [(i, t) for i, t in kept if not any(tuple(w[p : p + 10]) in windows for w in [split_words(t)] for p in range(len(w) - 9))]
    want = packed_ids(kept, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(want[i][p.start : at], "<u4").tobytes())
        assert at == len(want[i])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_extra_columns(spark, tmp_path):
    rows, items = corpus(7)
    spark.createDataFrame([(None, None), (1, None), (None, items[0]), *enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(*r, "x", 1, True) for r in rows] + [(None, rows[3][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(odd, SCHEMA + ", clean_text string, n_words long, kept boolean")
    for _, stage_ in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage_(spark, docs, str(tmp_path)).collect(), SCHEMA)
    assert docs.columns == corpus_pipeline.COLUMNS and docs.where("doc_id IS NULL").count() == 0 and docs.count() > 30
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 30


def test_an_item_without_an_id_is_a_leak(spark, tmp_path):
    rows, items = corpus(8)
    spark.createDataFrame([(None, items[0]), *list(enumerate(items))[1:]], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r[0] for r in rows} - {r[0] for r in stage(spark, tmp_path, 3, [r for r in rows if r[0] >= 120])} >= {130, 131, 132, 133}
