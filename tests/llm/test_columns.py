"""Columns of the caller that clash with names of the operators, by case, by their own names or by internal ones."""

import pytest
from pyspark.sql import functions as F

from clausemill.llm import chat, decontaminate, html_crf, jaccard, line_dedup, packing, pii, quality, token_tree, warc
from clausemill.llm.columns import Passing, picked, place_of

EXTRA = [
    "row", "runs", "whole", "lines", "words", "page", "spans", "candidates", "c0", "c1", "C2", "part", "found", "source", "block", "__row", "__text", "__runs", "__candidates", "__words",
    "N_Words", "N_HIT", "Matches", "ITEM_IDS", "BASE", "Added", "N_Deleted", "KEPT", "Clean_Text", "n_TOKENS", "Doc_Tokens", "node", "token", "n",
]
TEXT = "A plain sentence that ends as it should, with a few more words in it for good measure here now. Mail me at a@b.com."


def wide(spark):
    rows = [(1, TEXT), (2, None), (None, ""), (1, TEXT)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


def benchmark(spark):
    return spark.createDataFrame([(1, "ends as it should, with a few more words in it", "x")], "item_id long, text string, TEXT string")


@pytest.mark.parametrize(
    "added, run",
    [
        (["n_deleted"], lambda s, d: line_dedup.dedup_lines(d)),
        (list(quality.ADDED), lambda s, d: quality.line_first_quality(d)),
        (["n_words", "n_hit", "item_ids", "matches"], lambda s, d: decontaminate.find_matches(d, benchmark(s), with_matches=True)),
        ([], lambda s, d: decontaminate.decontaminate(d, benchmark(s))),
        (["base", "added"], lambda s, d: pii.find_personal_data(d)),
        (list(token_tree.ADDED), lambda s, d: token_tree.count_tokens(d)),
        (["main"], lambda s, d: html_crf.extract(d, html="text", out="main", model=({}, [[0.0, 0.0], [0.0, 0.0]]))),
        ([], lambda s, d: jaccard.keep_one(d)),
    ],
    ids=["op2", "op4", "op8", "op8-filter", "op10", "op1", "op6", "op7-filter"],
)
def test_other_columns_pass_through_untouched(spark, added, run):
    docs = wide(spark)
    out = run(spark, docs)
    stay = [c for c in EXTRA if c.lower() not in added]
    assert [c for c in out.columns if c in EXTRA] == stay and len({c.lower() for c in out.columns}) == len(out.columns)
    assert set(added) <= set(out.columns) and "doc_id" in out.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in stay)
    for empty in (docs.limit(0), docs.where("false")):
        assert run(spark, empty).collect() == []


def test_operators_that_pick_columns_take_them_among_clashing_ones(spark):
    docs = wide(spark).withColumn("doc", F.lit(1)).select("*", F.lit("other").alias("TEXT"), F.lit(7).alias("Doc_Id"))
    assert {r.doc_id: r.n_shingles for r in jaccard.near_duplicates(docs).collect()}[1] > 10
    assert {r.doc_tokens for r in packing.pack_documents(docs).collect() if r.doc_id == 2} == {1}
    turns = docs.select("*", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("ROLE"))
    assert chat.format_conversations(turns, conv="doc_id").count() == 3
    records = spark.createDataFrame([], warc.RECORD).select("*", F.lit(1).alias("URL"), F.lit(2).alias("Kind"))
    assert warc.resolve_revisits(records).collect() == []


def test_places_and_names():
    assert place_of(["Text", "text"], "text") == 1 and place_of(["TEXT"], "text") == 0
    with pytest.raises(ValueError, match="no column text"):
        place_of(["a"], "text")


def test_names_come_back_in_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, c1 int")
    p = Passing(df, ["b"], without=["A"])
    assert p.outer(p.inner.withColumn("b", F.lit(9)), "b").first().asDict() == {"c1": 3, "b": 9}
    assert picked(df, x="b").columns == ["x"]
