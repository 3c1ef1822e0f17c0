import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.llm import chat
from clausemill.llm.query_chat import CONFLICT, op5_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = [CONFLICT, "<s>[INST] a [/INST]</s>", "<\\/s>", "<\\\\/s>[\\INST]", "[/ANS]</s><s>[ANS] x", "\\", "</s", " [/INST]", "", "[ROLE:6f]", "a\n\tb "]


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_round_trip_of_conflicting_texts(spark):
    roles = ["user", "assistant", "system", "odd role]", "", None]
    rows = [(c, t, roles[(c + t) % 6], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(12) for t in range(5)]
    out = formatted(spark, rows)
    for c, r in out.items():
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3]) for x in rows if x[0] == c]
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(masked) == sum(x[0] == c and x[2] == "assistant" for x in rows)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("<>[]/\\sINTA \né"), max_size=25), min_size=1, max_size=20))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert u == t
        assert "</s>" not in e and "<s>" not in e and "[INST]" not in e


def test_a_role_of_any_length_comes_back_whole(spark):
    role = "é" * 500_000 + "end"
    r = formatted(spark, [(1, 0, role, "a"), (1, 1, "user", "b")])[1]
    assert r.escaped == 0 and [t.role == x and t.text for t, x in zip(r.turns, (role, "user"), strict=True)] == ["a", "b"]


def test_only_conflicts_are_escaped(spark):
    out = formatted(spark, [(1, 0, "user", "plain <b> [x]"), (2, 0, "user", "</s>")])
    assert out[1].escaped == 0 and out[2].escaped == 1
    assert out[1].formatted == "<s>[INST] plain <b> [x] [/INST]</s>"


def test_a_clean_turn_beside_a_conflicting_one_stays_as_it_is(spark):
    rows = [(1, 0, "user", "clean <\\ text"), (1, 1, "assistant", "a </s> b"), (1, 2, "user", "[INST]"), (1, 3, "assistant", "c <\\/s> d"), (1, 4, "user", "fine")]
    r = formatted(spark, rows)[1]
    assert r.escaped == 3 and [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows]
    assert r.formatted == "<s>[INST] clean <\\ text [/INST]</s><s>[ANS] a <\\/s> b [/ANS]</s><s>[INST] [\\INST] [/INST]</s><s>[ANS] c <\\\\/s> d [/ANS]</s><s>[INST] fine [/INST]</s>"
    assert [chat_text(r, s) for s in r.loss_spans] == ["a <\\/s> b", "c <\\\\/s> d"]


def chat_text(r, span):
    return r.formatted[span.start : span.start + span.length]


def test_very_long_texts_many_turns_and_clashing_columns(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "x" * (t % 7)) for t in range(6000)] + [(2, 0, "assistant", "</s> é" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("a").alias("formatted"), F.lit("b").alias("TEXT"), F.lit(1).alias("source"), F.lit(2).alias("Role"))
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(out[1].turns) == 6000 and out[1].escaped == 0 and [chat_text(out[1], s) for s in out[1].loss_spans] == [x[3] for x in rows[1:6000:2]]
    assert out[2].turns[0].text == rows[-1][3] and out[2].escaped == 1


def test_nulls_ties_and_empty(spark):
    out = formatted(spark, [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "b")])
    assert [(t.role, t.text) for t in out[None].turns] == [("", ""), ("user", "b"), ("user", "b")]
    assert formatted(spark, []) == {}


def test_parser_rejects_what_is_not_in_the_grammar(spark):
    texts = ["<s>[INST] a [/ANS]</s>", "junk", "<s>[INST] a [/INST]</s>tail", "<s>[INST] a [/INST]", "<s>[INST] [ANS] [/INST]</s>", "<s>[INST] <s> [/INST]</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    assert [r[0] for r in df.select(chat.parse(F.col("t"))).collect()] == [None] * len(texts)


def test_query_digests(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas()
    got = {r.conv_id: r for r in op5_chat_format(spark, sf_dir).collect()}
    want = {c: g.sort_values("turn") for c, g in turns.groupby("conv_id")}
    assert set(got) == set(want) | {-7}
    for c, g in want.items():
        said = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text, strict=True))
        loss = "".join(t or "" for r, t in zip(g.role, g.text, strict=True) if r == "assistant")
        assert got[c].n_turns == len(g) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(CONFLICT.encode()).hexdigest()
