"""Subword counts and chunks, and percentiles by narrowing ranges, against plain loops."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.functions import subword
from clausemill.operators import documents
from clausemill.plans.catalog import QUERIES

VOCABULARY = ["un", "##aff", "##able", "##a", "a", "the", "fee", "##s", "f", "##e", ".", ",", "é", "##", "中", "to", "token", "##ken", "##iz", "##ation"]


def plain_cut(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            piece = word[at:stop] if at == 0 else f"##{word[at:stop]}"
            if piece in vocabulary:
                out.append(piece)
                at = stop
                break
        else:
            return None
    return out


def plain_count(text, vocabulary, pattern=re.compile(r"[^\w\s]|_|[一-鿿]|[^\W_]+", re.U)):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")
    n = 0
    for w in plain.split():
        for x in re.findall(r"[一-鿿]|[^\W_]+|.", w):
            n += len((plain_cut(x, vocabulary) if len(x) <= 100 else None) or [0])
    return n


def test_longest_match_first():
    pieces = subword.Pieces(VOCABULARY)
    assert pieces.cut("unaffable") == ["un", "aff", "able"] and pieces.cut("tokenization") == ["token", "iz", "ation"] and pieces.cut("fees") == ["fee", "s"]
    assert pieces.cut("zebra") is None and pieces.count("zebra") == 1 and pieces.count("a" * 101) == 1 and pieces.count("a" * 100) == 100
    assert pieces.count("The fée, the FEES.中a") == 9 and pieces.count("") == 0 and pieces.count("\x00​ \n") == 0
    r = random.Random(1)
    for _ in range(500):
        w = "".join(r.choice("unafblestokiz") for _ in range(r.randint(1, 12)))
        found = plain_cut(w, set(VOCABULARY))
        assert pieces.cut(w) == (found and [p.removeprefix("##") for p in found])


def test_counts_and_chunks_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, ""), (7, "Twice here. " * 100)], "doc_id long, text string"))
    r = random.Random(2)
    letters = sorted({c for row in docs.collect() for c in unicodedata.normalize("NFD", (row.text or "").lower())})
    vocabulary = sorted({p for c in letters for p in (c, f"##{c}")} | {f"##{r.choice(letters)}{r.choice(letters)}" for _ in range(500)} | {"the", "##tion", "en", "##en", "##er"})
    count = subword.counter(spark, vocabulary)
    known = set(vocabulary)
    got = docs.select("text", subword.subword_count(count, F.col("text")).alias("n")).collect()
    pieces = subword.Pieces(vocabulary)
    assert all(x.n == pieces.count(x.text or "") for x in got) and sum(x.n for x in got) > 1000
    plain = [x for x in got if re.fullmatch(r"[\w\s.,]*", x.text or "", re.A)]
    assert plain and all(x.n == plain_count(x.text, known) for x in plain)
    chunks = documents.subword_chunks(docs, count, separator=r"\n", limit=60).collect()
    assert {c.estimated_tokens for c in chunks} and all(c.estimated_tokens == pieces.count(c.text) for c in chunks)
    whole = documents.document_chunks(docs, separator=r"\n", limit=10**9).select("doc_id", "paragraph_id", "text")
    joined = {}
    for c in sorted(chunks, key=lambda c: c.chunk_id):
        joined.setdefault((c.doc_id, c.paragraph_id), []).append(c)
    for p in whole.collect():
        own = joined[p.doc_id, p.paragraph_id]
        if p.doc_id is not None and p.doc_id != 7:
            assert " ".join(c.text for c in own).split() == p.text.split()
            assert (len(own) == 1) or pieces.count(p.text) > 60
            for a, b in zip(own, own[1:], strict=False):  # greedy: the next sentence did not fit
                assert a.is_subchunk and a.estimated_tokens + 1 <= 60 + pieces.count(a.text) and a.estimated_tokens + b.estimated_tokens > 60 or b.is_subchunk


def test_query_counts_whole_documents(spark, sf_dir):
    import public_tokenizers

    pieces = subword.Pieces(subword.vocabulary_of(str(public_tokenizers.path("word_bpe_49k.json"))))
    rows = QUERIES["subword_chunks"](spark, sf_dir).collect()
    texts = {(r.doc_id, r.paragraph_id): r.text for r in documents.document_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), separator=r"\n", limit=10**9).collect()}
    single = [r for r in rows if not r.is_subchunk and pieces.count(texts[r.doc_id, r.paragraph_id]) <= 128]
    assert len(single) > 100 and {(r.doc_id, r.paragraph_id) for r in rows} == set(texts)
    assert all(r.estimated_tokens == pieces.count(texts[r.doc_id, r.paragraph_id]) and r.text_md5 == hashlib.md5(texts[r.doc_id, r.paragraph_id].encode()).hexdigest() for r in single)


@pytest.mark.parametrize("make", [lambda r: float(r.randint(0, 30)), lambda r: r.gauss(0, 1e6), lambda r: 10.0 ** r.randint(-6, 6), lambda r: 7.0, lambda r: r.choice([5e-324, 1e-323, 0.0])])
def test_percentiles_are_exact(spark, make):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else make(r)) for _ in range(900)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x.k: [x[s] for s in shares] for x in documents.percentiles(df, "v", shares, "k").collect()}
    for k in ("a", "b", None, "one"):
        own = [v for a, v in rows if a == k and v is not None]
        assert got[k] == pytest.approx(np.percentile(own, [100 * s for s in shares.values()]).tolist(), rel=1e-12, abs=1e-300)
    assert set(got) == {"a", "b", None, "one"}
    whole = documents.percentiles(df, "v", shares).first()
    assert list(whole) == pytest.approx(np.percentile([v for _, v in rows if v is not None], [100 * s for s in shares.values()]).tolist(), rel=1e-12, abs=1e-300)
    profile = {x.k: (x.n, x.p50, x.share_over) for x in documents.length_profile(df, F.col("v"), 3.0, "k").collect()}
    assert profile["one"] == (1, 3.0, 0.0) and profile["none"][0] == 0 and profile["none"][1] is None


def test_a_run_between_blanks_is_looked_at_once(monkeypatch):
    pieces, asked, plain = subword.Pieces(VOCABULARY), [], subword.words_of
    monkeypatch.setattr(subword, "words_of", lambda t: (asked.append(t), plain(t))[1])
    assert pieces.count("the fees, " * 500 + "the\n\tfees") == 4 * 500 - 500 + 500 * 1 + 3 and len(asked) == 3
    r = random.Random(5)
    marks = "aÁΣσé \t\n\r\x0b\x0c\x85   .,-中\x00�̣ṩIİ"
    for _ in range(2000):
        t = "".join(r.choice(marks) for _ in range(r.randint(0, 14)))
        cuts = [pieces.cut(w) for w in plain(t)]
        assert pieces.count(t) == sum(len(c) if c else 1 for c in cuts)
