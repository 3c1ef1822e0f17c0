"""Texts that are not valid UTF-8: every operator takes them, by one rule."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import chat, decontaminate, html_crf, jaccard, line_dedup, packing, pii, quality, repair, token_tree, trie_join, warc
from clausemill.llm.columns import utf8

BAD, GOOD = "CAST(X'6f6b20fffe20656e6420c3' AS STRING)", "ok �� end �"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.sql(f"SELECT 1L AS doc_id, {BAD} AS text, 'a' AS lang, 'b' AS source, 9L AS n_chars"), spark.sql("SELECT 1L AS doc_id, 'x' AS text, 'a' AS lang, 'b' AS source, 9L AS n_chars").withColumn("text", F.lit(GOOD))


def same(run, docs):
    bad, good = (run(d).collect() for d in docs)
    assert bad == good
    return bad


def test_the_rule(spark):
    assert spark.sql(f"SELECT {BAD} AS t").select(utf8(F.col("t")).alias("t")).first().t == GOOD


def test_operators_on_documents(spark, docs):
    benchmark = spark.sql(f"SELECT 1L AS item_id, {BAD} AS text")
    assert same(lambda d: token_tree.count_tokens(d.select("doc_id", "text")), docs)[0].n_tokens > 3
    edits = f"array(named_struct('start', 0L, 'length', 1L, 'replacement', {BAD}), NULL)"
    assert same(lambda d: token_tree.count_tokens(d.select("text", F.expr(edits).alias("edits"))), docs)[0].edited_chars == 2 * len(GOOD) - 1
    assert same(lambda d: line_dedup.dedup_lines(d.union(d), min_words=3), docs)[0].text == GOOD
    assert same(lambda d: quality.line_first_quality(d.select("doc_id", "text").withColumn("text", utf8(F.col("text")))), docs)[0].n_words == 4
    assert quality.line_first_quality(docs[0]).first().word_chars == quality.line_first_quality(docs[1]).first().word_chars
    assert same(lambda d: html_crf.extract(d, html="text", out="main", model=({}, [[0.0, 1.0], [0.0, 0.0]])), docs)
    assert same(jaccard.near_duplicates, docs)[0].n_shingles == 1
    assert same(lambda d: decontaminate.find_matches(d, benchmark), docs)[0].n_hit == 4
    assert same(packing.pack_documents, docs)[0].length > 3
    assert pii.find_personal_data(docs[0].withColumn("text", F.concat("text", F.lit(" a@b.com")))).first().base[0].start == len(GOOD) + 1


def test_operators_on_other_tables(spark, docs):
    turns = docs[0].select("doc_id", F.lit(0).alias("turn"), F.col("text").alias("role"), "text")
    row = chat.format_conversations(turns, conv="doc_id").first()
    assert row.faithful and [(t.role, t.text) for t in row.turns] == [(GOOD, GOOD)]
    row = repair.repair_conversations(turns.withColumn("role", F.lit("user")), conv="doc_id").first()
    assert (row.truncated, row.audit) == (1, "D")
    names = docs[0].select(F.col("text").alias("name"))
    assert trie_join.near_names(names, names).first().query == GOOD
    at = "timestamp'2024-01-01'"
    records = spark.sql(
        f"SELECT 1L AS record_id, concat('http://a/', {BAD}) AS url, {at} AS ts, 'response' AS kind, 200 AS status, {BAD} AS etag, NULL AS last_modified, NULL AS digest, map('etag', {BAD}) AS headers "
        f"UNION ALL SELECT 2L, 'http://a/{GOOD}', {at} + INTERVAL 1 DAY, 'revisit', 304, {BAD}, NULL, NULL, map('etag', {BAD})"
    )
    assert warc.resolve_revisits(records).first().outcome == "matched"


def test_pipeline(spark, docs, tmp_path):
    text = " ".join(f"word{k}" for k in range(40)) + "."
    bad = docs[0].select("doc_id", F.concat(F.lit(text), "text", F.lit(" so that is all.")).alias("text"), "lang", "source", "n_chars")
    bad.write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 1L AS item_id, 'nothing of this' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).first().length > 40
