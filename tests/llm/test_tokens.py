import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausemill.llm.query_tokens import op1_token_counts
from clausemill.llm.token_tree import TokenTree, count_tokens, leaves_of, with_edits
from clausemill.llm.tokenizer import Coder, vocabulary

ALPHABET = ["a", "the", " ", "  ", "\n", "é", "1", "2.5", "'s", "'", "!", " ", "　", "<|endoftext|>", "ß", "中", "\t", "x" * 9]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def text_of(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def edited(text, start, length, new):
    start = max(0, min(start, len(text)))
    return text[:start] + new + text[start + max(0, length) :]


def test_leaves_add_up(whole):
    r = random.Random(1)
    for _ in range(100):
        text = text_of(r, 80)
        leaves = leaves_of(text, r.choice([1, 4, 20]))
        assert "".join(leaves) == text and sum(map(whole, leaves)) == whole(text)


def test_tree_under_random_edits(whole):
    code, r = Coder(vocabulary()), random.Random(2)
    for _ in range(60):
        text = text_of(r, r.choice([0, 1, 30, 200]))
        tree = TokenTree(text, code.count, r.choice([1, 8, 40]))
        assert tree.total == whole(text)
        for _ in range(25):
            start, length, new = r.randint(-3, len(text) + 3), r.choice([0, 0, 1, 3, 40]), text_of(r, r.choice([0, 0, 1, 3, 60]))
            tree.edit(start, length, new)
            text = edited(text, start, length, new)
            assert tree.text() == text and tree.length == len(text) and tree.total == whole(text)


def test_an_edit_encodes_a_small_part():
    code = Coder(vocabulary())
    tree = TokenTree("some words in a line. " * 5000, code.count)
    before = tree.encoded
    tree.edit(50_000, 4, "other words")
    assert tree.encoded - before < 2_000


def test_operator_with_a_log(spark, whole):
    docs = spark.createDataFrame([(1, "one two three", "x"), (1, "four", "y"), (2, None, "z"), (None, "five", "w")], "doc_id long, text string, n_tokens string")
    log = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 100, 0, " end"), (2, 1, 5, 5, None), (None, 1, 0, 0, "no")], "doc_id long, seq int, start int, length int, replacement string")
    got = {(r.doc_id, r.edited_chars): r for r in count_tokens(with_edits(docs, log)).collect()}
    assert set(got) == {(1, 15), (1, 6), (2, 0), (None, 4)}
    assert got[1, 15].n_tokens == whole("one two three") and got[1, 15].edited_tokens == whole("1 two three end")
    assert got[2, 0].n_tokens == got[2, 0].edited_tokens == 0 and got[None, 4].encoded_again == 0
    assert count_tokens(docs.limit(0)).collect() == []


def test_a_second_batch_of_edits_encodes_only_what_it_touches(spark, whole):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, text_of(r, 3000), "x") for i in range(20)] + [(20, None, "x"), (21, "some words here. " * 40_000, "x")], "doc_id long, text string, Tree string")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    first = count_tokens(docs.drop("Tree"), edits=None, keep_tree=True)
    held = spark.createDataFrame(first.collect(), first.schema)
    for seed in (5, 6):
        r = random.Random(seed)
        log = [(i, s, r.randint(0, len(t)), r.choice([0, 3, 20]), text_of(r, 3)) for i, t in texts.items() for s in range(2) if i % 3 != seed % 3]
        out = count_tokens(with_edits(held.select("doc_id", "text", "tree"), spark.createDataFrame(log, "doc_id long, seq int, start int, length int, replacement string")), keep_tree=True)
        held = spark.createDataFrame(out.collect(), out.schema)
        for i, _, start, length, new in log:
            texts[i] = edited(texts[i], start, length, new)
        for x in held.collect():
            touched = sum(e[0] == x.doc_id for e in log)
            assert x.text == texts[x.doc_id] and x.edited_tokens == whole(x.text) and x.edited_chars == len(x.text)
            assert x.encoded_chars == x.encoded_again <= 2500 * touched, (x.doc_id, touched)
    stale = held.withColumn("text", F.concat(F.lit("b"), F.substring("text", 2, 10**9)))
    assert all(x.n_tokens == whole(x.text) for x in count_tokens(stale, edits=None, keep_tree=True).collect())


def test_query_against_whole_texts(spark, sf_dir, whole):
    got = {r.doc_id: r for r in op1_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text, n = r.text, len(r.text)
        for start, length, new in ((n // 2, 0, f" [from {r.source}] "), (n // 4, 17, ""), (int(n * 0.9), 6, r.lang.upper()), (n + 100, 0, "\nEnd of document.")):
            text = edited(text, start, length, new)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].edited_tokens, got[r.doc_id].edited_chars) == (whole(r.text), whole(text), len(text))
