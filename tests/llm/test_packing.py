import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausemill.llm.packing import difference, pack_block, pack_documents
from clausemill.llm.tokenizer import Coder, vocabulary


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.integers(1, 6))
def test_difference_is_a_partition(sizes, k):
    groups = difference(sizes, k)
    assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(len(sizes)))


def test_difference_is_near_the_best_on_small_cases():
    r = random.Random(3)
    for _ in range(20):
        sizes = [r.randint(1, 50) for _ in range(7)]
        best = min(max(sum(s for s, g in zip(sizes, gs, strict=True) if g == j) for j in range(3)) for gs in product(range(3), repeat=7))
        got = max(sum(sizes[i] for i in g) for g in difference(sizes, 3))
        assert got <= best * 1.25


def test_classic_example_of_two_way_differencing():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def covered(windows, sizes, capacity):
    """Every token of every rest is in one piece, and no window holds too much."""
    assert all(0 < sum(n for _, _, n in w) <= capacity for w in windows)
    for i, size in enumerate(sizes):
        own = sorted((start, n) for w in windows for j, start, n in w if j == i)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == size


def test_only_the_residue_is_cut():
    windows = pack_block([600, 600, 600], 1024)
    covered(windows, [600, 600, 600], 1024)
    assert len(windows) == 2 and sum(map(len, windows)) == 4  # one cut
    r = random.Random(1)
    for most in (40, 256, 1023):
        sizes = [r.randint(1, most) for _ in range(1024)]
        windows = pack_block(sizes, 1024)
        covered(windows, sizes, 1024)
        cut = {i for w in windows for i, _, n in w if n < sizes[i]}
        assert len(cut) < 0.5 * len(sizes) and len(windows) * 1024 <= 1.01 * sum(sizes) + 1024
        assert all(n >= 8 for w in windows for i, _, n in w if n < sizes[i])


def test_window_count_rises_where_cuts_do_not_help():
    sizes = [1023] * 5 + [10]
    windows = pack_block(sizes, 1024, fine=16)
    covered(windows, sizes, 1024)
    assert len(windows) == 6 and all(n == sizes[i] for w in windows for i, _, n in w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(1, 20))
def test_blocks_of_any_sizes(sizes, fine):
    covered(pack_block(sizes, 64, fine), sizes, 64)


def test_coder_agrees_with_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code = Coder(vocabulary())
    assert code.fast
    r = random.Random(5)
    texts = ["", " ", "a<|endoftext|>b", "été  ñandú\n\n x's", "中文   ½ ²", "\x00\x85\xa0 a"]
    texts += ["".join(r.choice("aé 's\n\t1½².,!ß ") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(code.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pack_documents_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-1, "", "x"), (-2, "word " * 5000, "x")], "doc_id long, text string, lang string")
    rows = pack_documents(docs.unionByName(extra), with_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for r in docs.unionByName(extra.where("doc_id = -2")).collect():
        got = [i for p in sorted(by_doc[r.doc_id], key=lambda p: p.start) for i in p.ids]
        assert got == [*whole.encode(r.text, add_special_tokens=False).ids, 0]
    assert len(by_doc[None]) == 1 and len(by_doc[-1]) == 2
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padded += 1024 - at
    total = sum(r.length for r in rows)
    assert padded < 0.02 * total
    short = {r.doc_id for r in rows if r.doc_tokens <= 1024 and (r.doc_id or 0) >= 0}
    whole_ones = {r.doc_id for r in rows if r.length == r.doc_tokens}
    assert len(short & whole_ones) > 0.6 * len(short)
    assert pack_documents(docs.limit(0)).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, text string, TEXT string, length int, sequence_id int")
    assert [(r.doc_id, r.length, r.offset) for r in pack_documents(docs).collect()] == [(1, 3, 0)]
