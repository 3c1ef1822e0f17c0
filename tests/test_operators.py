import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.functions import numeric as N
from clausemill.functions import text as T
from clausemill.operators import documents, paired, relational, resample, retrieval, scoring, similarity, splits
from clausemill.plans.catalog import QUERIES
from clausemill.plans.label_queries import cells
from clausemill.schemas import assert_no_violations, first_column, require

QUIET = dict(deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_strip_takes_every_blank_and_no_more(spark):
    c = F.concat(F.col("c"), F.col("c"), F.lit("a"), F.col("c"), F.lit("b"), F.col("c"))
    rows = spark.createDataFrame([(chr(i),) for i in [*range(0xD800), *range(0xE000, 0x10FFFF, 1)] if i < 0x10000 or i % 251 == 0], "c string")
    told = rows.select((T.strip(c) == F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).alias("one"), (T.collapse(c) == F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")).alias("other"))
    assert told.where("one AND other").count() == rows.count()


def test_blanks_and_compositions(spark):
    row = one(spark, T.collapse(F.lit("  a  b\n\tc　")), T.clause_text(F.lit("ﬁne ½")), T.line_ends(F.lit(" a\r\nb ")), T.collapse(F.lit(None).cast("string")))
    assert tuple(row) == ("a b c", "fine 1⁄2", "a\nb", "")


def test_code_scores(spark):
    cases = ["acc_sus 0", "ip -1", "tran 1 ", "x -0", "x 1 y", "x 2", "  ", "docu...", "uncle r", "zzz 1", "ip"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    alias = {"ip": "IP", "tran": "transfer"}
    got = df.select(T.code_of(F.col("s"), alias), T.score_of(F.col("s")), T.segment_status(F.col("s"), ["acc_sus", "IP", "transfer", "x"], alias)).collect()
    assert [tuple(r) for r in got] == [
        ("acc_sus", 0, "parsed"), ("IP", -1, "parsed"), ("transfer", 1, "parsed"), (None, None, "missing_score"), (None, None, "missing_score"), (None, None, "missing_score"),
        (None, None, "empty"), (None, None, "document_note"), (None, None, "unclear"), ("zzz", 1, "unknown_code"), (None, None, "missing_score"),
    ]


def test_small_text_functions(spark):
    row = one(
        spark, T.segments(F.lit("a; b,,c ;")), T.tri_state(F.lit(" Yes")), T.tri_state(F.lit("maybe")), *T.tag_parts(F.lit("ch2")), T.first_code(F.lit("see ARB-x or arb"), ["arb", "arbx"]),
        T.category_of(F.lit("q__a__Cat")), T.category_of(F.lit("q")), T.unfenced(F.lit("```json\n{}\n```")), T.recovered_score(F.lit("score: -1\n0")), T.recovered_score(F.lit("10")), T.label_key(F.lit(" Data__Sharing  x")),
        T.expanded_query(F.lit("Who may Audit?"), {"audit": "inspection", "who": "party"}), T.truncated(F.lit("abcdefgh"), 1), T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), N.flag_text(F.lit(None).cast("boolean")), N.half_even(F.lit(0.12345), 4),
    )
    assert tuple(row) == (["a", "b", "c"], True, None, "ch", 2, "arb", "Cat", "unknown", "{}", -1, None, "data sharing x", "Who may Audit? inspection", "abcd\n[truncated]", 0.5, "", round(0.12345, 4))


def test_containment(spark):
    cases = [("One  two", "zero ONE two three", True), ("a b c d e f g", "x b c d e f g y", True), ("a b c d e f g", "x b c d e f y", False), ("a b c d e f", "za b c d e fy", True), ("", "x", True)]
    df = spark.createDataFrame(cases, "n string, h string, w boolean")
    assert all(r[0] == r[1] for r in df.select(T.contains_text(F.col("n"), F.col("h")), "w").collect())


def plain_syllables(word):
    word = word.lower().strip(".,;:!?\"'()[]")
    if not word:
        return 0
    n = sum(1 for i, c in enumerate(word) if c in "aeiouy" and (i == 0 or word[i - 1] not in "aeiouy"))
    return max(1, n - (word.endswith("e") and n > 1 and word[-2:] not in ("le", "ee")))


@settings(max_examples=5, **QUIET)
@given(st.lists(st.text("aeiouylbt'E", max_size=8), min_size=30, max_size=60))
def test_syllables(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.syllables(F.col("w"))).collect()] == [plain_syllables(w) for w in words]


def test_softmax_and_argmax(spark):
    row = one(spark, N.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(-800.0))), N.argmax(F.array(F.lit(2.0), F.lit(5.0), F.lit(5.0))), N.positive(F.lit(0.0)), N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))))
    assert row[0] == [0.5, 0.5, 0.0] and row[1] == 1 and row[2] is True and row[3] is None


@settings(max_examples=8, **QUIET)
@given(st.lists(st.integers(1, 12), max_size=15), st.integers(3, 15))
def test_packing_is_the_greedy_loop(spark, sizes, limit):
    parts = [" ".join(["w"] * n) for n in sizes]
    want, open_, n = [], [], 0
    for p, k in zip(parts, sizes, strict=True):
        if n + k > limit and open_:
            want.append(" ".join(open_))
            open_, n = [], 0
        open_.append(p)
        n += k
    want += [" ".join(open_)] if open_ else []
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(documents.packed(F.col("p"), documents.word_tokens, limit)).first()[0] == want


def test_paragraphs_and_chunks(spark):
    text = "Short.\r\n\r\nThis is a paragraph of some length. It has two sentences.\n\n\n\n  \n\n" + "Word word word word word. " * 6
    paras = documents.paragraphs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    rows = paras.orderBy("paragraph_id").collect()
    assert [(r.paragraph_id, r.skipped) for r in rows] == [(0, True), (1, False), (2, False)] and rows[0].text == "Short."
    pieces = documents.chunks(paras, limit=14).orderBy("chunk_id").collect()
    assert [(p.chunk_id, p.paragraph_id, p.is_subchunk) for p in pieces] == [(0, 1, False), (1, 2, True), (2, 2, True), (3, 2, True)]
    assert documents.harm_filter([" ", "BAD", "neutral"]) == ["Harmful", "Neutral"] and documents.harm_filter([]) == ["Harmful"]
    with pytest.raises(ValueError):
        documents.harm_filter(["odd"])


def test_overlapping_chunks(spark):
    text = "Sentence one is here. " * 100 + "\n\n" + "x" * 2500
    rows = documents.overlapping_chunks(spark.createDataFrame([("f", text), ("g", "")], "doc_id string, text string")).orderBy("chunk_index").collect()
    assert all(len(r.text) <= 1000 for r in rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].text.endswith(".") and rows[-1].text.endswith("x" * 200) and "".join(text.split())[:50] == "".join(rows[0].text.split())[:50]


def test_stratified_split(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 3, "few").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("k"))
    a = {r.row_id: r.split for r in splits.stratified_split(df, "k").collect()}
    b = {r.row_id: r.split for r in splits.stratified_split(df.repartition(7), "k").collect()}
    assert a == b and len(a) == 1000
    for rest in (0, 1):
        n = Counter(s for i, s in a.items() if i > 2 and i % 2 == rest)
        assert abs(n["test"] - 50) <= 1 and abs(n["validation"] - 50) <= 1
    g = splits.group_split(df, "k")
    assert splits.straddling(g, "k").count() == 0


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    assert sorted((r.v, r.row_id) for r in relational.numbered(df, ["v"]).collect()) == [(i, i) for i in range(1000)]
    assert sorted(r.v for r in relational.positions(df, ["v"], 10, 13).collect()) == [10, 11, 12]
    with pytest.raises(ValueError):
        relational.positions(df, ["v"], 5, 2)


@pytest.mark.parametrize("partitions", [2, 4, 8, 32])
def test_row_numbers_and_ranks_of_many_rows_with_payload(spark, partitions):
    """Against answers from the whole list: the plans prune different columns, so bounds taken twice would differ."""
    n = 200_000
    value = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)) / 10
    df = spark.range(0, n, 1, 7).select(F.xxhash64("id").alias("v"), F.concat(F.lit("p"), "id").alias("payload"), (F.col("id") % 3).alias("k"), value.alias("x"))
    rows = df.toPandas()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = relational.numbered(df, ["v"]).select("payload", "row_id").toPandas().set_index("payload")["row_id"]
        want = rows["v"].rank(method="first").astype("int64") - 1
        assert (got.loc[rows["payload"]].to_numpy() == want.to_numpy()).all()
        part = relational.positions(df, ["v"], 150_000, 150_010).select("payload").toPandas()["payload"]
        assert set(part) == set(rows["payload"][(want >= 150_000) & (want < 150_010)])
        ranks = paired.average_ranks(df.select("payload", "x", "k"), "x", "k").select("payload", "rank").toPandas().set_index("payload")["rank"]
        assert (ranks.loc[rows["payload"]].to_numpy() == rows.groupby("k")["x"].rank(method="average").to_numpy()).all()
        medians = {r.k: r.upper_median for r in documents.upper_median(df, "x", "k").collect()}
        assert medians == {k: sorted(own)[len(own) // 2] for k, own in rows.groupby("k")["x"]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_are_even_whatever_the_order_of_rows(spark):
    for df in (spark.range(20_000), spark.range(20_000).select((-F.col("id")).alias("id"))):
        bounds = relational.range_bounds(df, ["id"])
        sizes = [r["count"] for r in df.crossJoin(bounds).groupBy(relational.range_of(F.col("__bounds"), F.struct("id"), 100).alias("p")).count().collect()]
        assert len(sizes) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 3 * 20_000 / len(sizes)


def test_row_numbers_put_nulls_first_and_need_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (2.5, "b"), (float("nan"), "c"), (-1.0, "d")], "v double, p string")
    assert {r.p: r.row_id for r in relational.numbered(df, ["v"]).collect()} == {"a": 0, "d": 1, "b": 2, "c": 3}
    assert relational.numbered(df.limit(0), ["v"]).count() == 0


def test_rounding_goes_by_the_binary_value(spark):
    rng = random.Random(3)
    xs = [k / 1000 for k in range(0, 4000, 25)] + [rng.uniform(-1, 1) for _ in range(500)] + [round(rng.uniform(-50, 50), 5) for _ in range(500)] + [0.00005, 0.25, 0.75, 2.5, -0.04, 0.0, 1e9 + 0.25, None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.half_even(F.col("x"), 4).alias("r"), N.fixed(F.col("x"), 1).alias("t"), T.delta_cell(F.col("x")).alias("d")).collect()
    for r in rows:
        assert (r.r, r.t, r.d) == ((None,) * 3 if r.x is None else (round(r.x, 4), f"{r.x:.1f}", f"{r.x:+.3f}")), r


def test_lookup_and_rules_raise(spark):
    df, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert {r.v for r in relational.lookup(df, dim, ["k"]).collect()} == {"a", None}
    with pytest.raises(Exception, match="no entry for 2"):
        relational.lookup(df, dim, ["k"], required=True).collect()
    with pytest.raises(ValueError, match="small"):
        assert_no_violations(df, {"small": F.col("k") < 2})
    with pytest.raises(ValueError):
        require(df, ["x"])
    assert first_column(df, ["a", "k"]) == "k"


def test_poisson_weights_and_bootstrap(spark):
    w = spark.range(20_000).select(resample.poisson_weight(resample.uniform(F.lit(1), F.col("id"))).alias("w"))
    n = {r.w: r["count"] / 20_000 for r in w.groupBy("w").count().collect()}
    assert all(abs(n[k] - math.exp(-1) / math.factorial(k)) < 0.012 for k in range(4))
    rows = [(i, t, float((i * 7 + t) % 3 == 0), 1.0, int((i * 5 + t) % 2 == 0), int((i * 7 + t) % 3 == 0)) for i in range(150) for t in range(3)]
    cells = spark.createDataFrame(rows, "row_id long, topic_index int, label double, mask double, prediction int, prediction_b int")
    for r in resample.bootstrap_interval(cells, 60).collect():
        assert r.ci_low < r.point < r.ci_high and abs(r.mean - r.point) < 0.05
    d = resample.paired_delta(cells.withColumnRenamed("prediction", "prediction_a"), 60).first()
    assert d.delta < -0.3 and d.ci_high < 0 and d.p_value < 0.05


def test_exact_tests():
    assert resample.binomial_p(0, 0) == 1.0 and abs(resample.binomial_p(1, 10) - 22 / 1024) < 1e-9 and abs(resample.binomial_p(5, 10) - 1.0) < 1e-9
    assert abs(paired.t_p(2.0, 10) - 0.07338803) < 1e-6 and abs(paired.t_p(0.5, 3) - 0.65145) < 1e-3
    assert abs(paired.signed_rank_p(10, 8) - 0.048828125) < 1e-12 and paired.signed_rank_p(0, 0) == 1.0


def test_paired_comparison(spark):
    rows = [(float(i), float(i) + (1.5 if i % 4 else -0.5)) for i in range(40)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "before double, after double")
    t, w = paired.paired_test(df, True), paired.paired_test(df, False)
    assert t["n"] == 40 and abs(t["mean_difference"] - 1.0) < 1e-12 and t["p_value"] < 1e-6 and w["p_value"] < 1e-4 and w["effect_size"] > 0.8
    assert paired.paired_test(df.limit(2), True)["test"] == "insufficient data"


def plain_grams(text, low=3, high=5):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(low, high + 1):
            k = 0
            out.append(w[:n])
            while k + n < len(w):
                k += 1
                out.append(w[k : k + n])
            if k == 0:
                break
    return out


def test_bootstrap_queries_draw_a_thousand_times(spark, sf_dir):
    assert QUERIES["paired_bootstrap"](spark, sf_dir).first().replicates == 1000
    c = cells(spark, sf_dir)
    want = {r.metric: r.ci_low for r in resample.bootstrap_interval(c, 1000).collect()}
    assert {r.metric: r.ci_low for r in QUERIES["bootstrap_interval"](spark, sf_dir).collect()} == pytest.approx(want)


def test_nearest_by_grams(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 5)))
    train, test = [(i, text()) for i in range(25)], [(100 + i, text()) for i in range(10)] + [(200, "zzzz"), (201, "")]
    df = Counter(g for _, t in train for g in set(plain_grams(t)))
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(t):
        v = {g: n * idf[g] for g, n in Counter(plain_grams(t)).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    schema = "row_id long, text string"
    got = {x.id: x for x in similarity.nearest(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "row_id", "text").collect()}
    for i, t in test:
        v = vector(t)
        best = max((round(sum(x * u.get(g, 0) for g, x in v.items()), 9), -j) for j, u in ((j, vector(s)) for j, s in train))
        assert abs(got[i].similarity - best[0]) < 1e-8 and (not best[0] or got[i].best_id == -best[1])


def test_nearest_by_parts_in_blocks(spark):
    train = [(5, 1, "the quick brown fox"), (5, 0, "the quick brown fox"), (None, 0, "the quick brown fox"), (2, 3, "lazy dogs sleep"), (9, 0, "lazy dogs sleep all day"), (7, 0, None)]
    test = [(None, "the quick brown fox"), (1, "lazy dogs sleep"), (2, "99999"), (3, None)]
    frames = spark.createDataFrame(train, "row_id long, part long, text string").repartition(3), spark.createDataFrame(test, "row_id long, text string")
    for block_grams in (1, 10**6):
        got = {r.id: (r.best_id, r.best_part, round(r.similarity, 9)) for r in similarity.nearest(*frames, "row_id", "text", part="part", block_grams=block_grams).collect()}
        assert got == {None: (5, 0, 1.0), 1: (2, 3, 1.0), 2: (None, None, 0.0), 3: (None, None, 0.0)}


@pytest.mark.parametrize("block_grams", [400, 10**6])
def test_bounds_find_the_nearest_of_many_rows(spark, monkeypatch, block_grams):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words[: r.choice([20, 300])]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    train = list(enumerate(texts)) + [(k + 5000, x) for k, x in enumerate(r.sample(texts, 40))]
    test = [(k, x if k % 3 else " ".join(x.split()[::-1][:-1]) + " " + r.choice(words)) for k, x in enumerate(r.sample(texts, 40))]
    df = Counter(g for _, t in train for g in set(plain_grams(t)))
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(t):
        v = {g: n * idf[g] for g, n in Counter(plain_grams(t)).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    vectors = [(j, vector(s)) for j, s in train]
    live, most = [], []
    context = spark.sparkContext
    real = context.broadcast

    def counted(value):
        b = real(value)
        live.append(b)
        most.append(len(live))
        gone = b.destroy
        b.destroy = lambda *a, **k: (live.remove(b), gone(*a, **k))
        return b

    monkeypatch.setattr(context, "broadcast", counted)
    schema = "row_id long, text string"
    found = similarity.nearest(spark.createDataFrame(train, schema).repartition(3), spark.createDataFrame(test, schema), "row_id", "text", block_grams=block_grams)
    assert max(most) == 1 and not live and (len(most) > 5) == (block_grams == 400)
    got = {x.id: x for x in found.collect()}
    for i, t in test:
        v = vector(t)
        best = max((round(sum(x * u.get(g, 0) for g, x in v.items()), 9), -j) for j, u in vectors)
        assert abs(got[i].similarity - best[0]) < 1e-8 and (not best[0] or got[i].best_id == -best[1])


def test_few_candidates_are_left_of_many_rows(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 20))) for _ in range(2000)]
    test = list(enumerate(r.sample(texts, 30)))
    train = list(enumerate(texts)) + [(k + 5000, test[0][1]) for k in range(3000)]
    told, real = {}, similarity.written

    def kept(df, name, *by):
        told[name] = real(df, name, *by)
        return told[name]

    monkeypatch.setattr(similarity, "written", kept)
    schema = "row_id long, text string"
    got = {x.id: x for x in similarity.nearest(spark.createDataFrame(train, schema).repartition(3), spark.createDataFrame(test, schema), "row_id", "text").collect()}
    assert all(round(got[i].similarity, 9) == 1.0 and got[i].best_id == texts.index(t) for i, t in test)
    assert told["candidates"].count() <= 3 * 2 * len(test)  # a few for each task and item, copies once


@pytest.mark.parametrize("most", [60, 4_000, 40_000_000])
def test_candidates_in_pieces_of_any_size(monkeypatch, most):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    texts = ["", "a", *(" ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 40]))) for _ in range(300))]
    items = [" ".join(r.choice(words) for _ in range(12)) for _ in range(9)] + [texts[40], "xyzxyz"]
    counts = Counter(g for t in texts for g in set(plain_grams(t)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["id", "part", "text"])
    found = pa.Table.from_batches(similarity._document_counts(iter([rows.select(["text"])]))).to_pylist()
    assert sorted(x["df"] for x in found if x["gram"] is not None) == sorted(counts.values()) and [x["df"] for x in found if x["gram"] is None] == [len(texts)]
    known = sorted((x["gram"] % 2**64, math.log((1 + len(texts)) / (1 + x["df"])) + 1) for x in found if x["gram"] is not None and x["df"] >= 2)
    asked = similarity._Asked(list(range(11)), items, np.array([g for g, _ in known], dtype=np.uint64), np.array([w for _, w in known]))
    monkeypatch.setattr(similarity, "_CELLS", most)
    monkeypatch.setattr(similarity, "_SIZE", 4_000)
    later = [pa.RecordBatch.from_arrays([pa.array(range(500, 500 + len(texts))), *rows.columns[1:]], names=["id", "part", "text"])]
    told = pa.Table.from_batches(similarity._candidates(SimpleNamespace(value=asked), math.log((1 + len(texts)) / 3) + 1)(iter([rows, rows.slice(0, 0), *later]))).to_pylist()
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in counts.items() if n >= 2}

    def vector(t):
        v = {g: n * idf[g] for g, n in Counter(plain_grams(t)).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    vectors = [vector(t) for t in texts]
    for i, t in enumerate(items):
        v = vector(t)
        best, row = max((round(sum(x * u.get(g, 0) for g, x in v.items()), 9), -j) for j, u in enumerate(vectors))
        own = [x for x in told if x["item"] == i]
        assert bool(own) == bool(best) and all(x["lower"] <= best + 1e-9 for x in own)
        assert not best or any(x["best_id"] == -row and x["upper"] >= best - 1e-9 for x in own)


def test_rows_of_like_words_are_bounded_tightly(monkeypatch):
    r = random.Random(4)
    ends = ["".join(r.choice("bcdfgh") for _ in range(3)) for _ in range(60)]
    words = ["".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(300)]
    texts = [" ".join("international" + r.choice(ends) for _ in range(30)) + " " + " ".join(r.sample(words, 3)) for _ in range(400)]
    items = [" ".join(["international" + x for x in r.sample(ends, 4)] + r.sample(words, 2)) for _ in range(10)]
    texts += items
    counts = Counter(g for t in texts for g in set(plain_grams(t)))
    hashes = pa.Table.from_batches(similarity._document_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))).to_pylist()
    known = sorted((x["gram"] % 2**64, math.log((1 + len(texts)) / (1 + x["df"])) + 1) for x in hashes if x["gram"] is not None and x["df"] >= 2)
    assert len(known) == sum(n >= 2 for n in counts.values())
    asked = similarity._Asked(list(range(10)), items, np.array([g for g, _ in known], dtype=np.uint64), np.array([w for _, w in known]))
    pairs, real = [], similarity._Chunk.products
    monkeypatch.setattr(similarity._Chunk, "products", lambda self, i, j: (pairs.append(len(i)), real(self, i, j))[1])
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["id", "part", "text"])
    told = pa.Table.from_batches(similarity._candidates(SimpleNamespace(value=asked), math.log((1 + len(texts)) / 3) + 1)(iter([rows]))).to_pylist()
    assert {(i, 400 + i) for i in range(10)} <= {(x["item"], x["best_id"]) for x in told}
    assert sum(pairs) <= 10 * len(items)  # of 4,100; words that share their grams made bounds far above the cosines


def test_contamination_reads_all_documents(spark, tmp_path):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [words(30) for _ in range(3)]
    docs = [(i, words(40) + "\n\n" + words(20)) for i in range(20)] + [(50, words(300) + "\n" + items[1] + "\n" + words(300)), (51, words(9) + "\n" + items[1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, "user", items[0])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.id: x for x in QUERIES["tfidf_nearest"](spark, str(tmp_path)).collect()}
    assert (got[1].best_id, got[1].paragraph_id, got[1].similarity, got[1].at_least_95) == (50, 1, 1.0, True)
    assert not got[0].at_least_80 and not got[2].at_least_80
    assert QUERIES["contamination_shares"](spark, str(tmp_path)).first().share_at_least_95 == pytest.approx(1 / 3)


def test_shares_carry_copies_once(spark, tmp_path, monkeypatch):
    items = [(0, "the quick brown fox jumps"), (1, "over lazy dogs at night")]
    docs = [(i, f"{items[i % 2][1]}\nsome other words {i}") for i in range(1, 1500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    told, real = [], similarity.written

    def kept(df, name, *by):
        out = real(df, name, *by)
        told.extend([out] if name == "candidates" else [])
        return out

    monkeypatch.setattr(similarity, "written", kept)
    assert tuple(QUERIES["contamination_shares"](spark, str(tmp_path)).first()) == (2, 1.0, 1.0, 1.0)
    assert sum(df.count() for df in told) <= 2 * 2 * 8  # for each task and item


def test_cut_references_stay(spark, tmp_path):
    pages = [(1, "<h1>A &amp; B &am</h1><p>x&amp</p>&lt;&#65;&nbsp;&ampcopy;"), (2, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_clean_entities"](spark, str(tmp_path)).collect()}
    assert got == {1: "A & B &am x&amp <A &ampcopy;", 2: ""}


def test_jaccard_of_ids_far_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (70, "x y z"), (900, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "D c b e"), (6, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.doc_id): r.jaccard for r in QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(5, 1): 0.6, (5, 70): 0.0, (5, 900): 0.0, (6, 1): 0.0, (6, 70): 0.0, (6, 900): 1.0}


def test_merged_changes(spark):
    rows = [
        (1, 0, "The service may now collect device location data", "fair", "added"), (1, 1, "The service MAY now collect device location data!", "harmful", "modified"),
        (1, 2, "The service may now collect device location data too", "harmful", "added"), (1, 3, "Arbitration is now mandatory for all disputes", "harmful", "modified"), (1, 4, "", "odd", None), (1, 5, None, "neutral", "removed"),
    ]
    got = similarity.merged_changes(spark.createDataFrame(rows, "doc_id long, pos long, what_changed string, harm_label string, change_type string")).orderBy("id").collect()
    assert [(r.id, r.harm_label) for r in got] == [("change_001", "harmful"), ("change_002", "neutral"), ("change_003", "fair"), ("change_004", "odd")]


def test_relevance_against_brute_force(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcd") * r.randint(1, 2) for _ in range(n))
    chunks = [(0, i, text(30)) for i in range(15)]
    answers = [(0, i, r.choice([text(2), text(5), text(8), chunks[i % 15][2][3:25]])) for i in range(25)]

    def holds(needle, hay):
        n, h = " ".join(needle.lower().split()), " ".join(hay.lower().split())
        w = n.split()
        return n in h or any(" ".join(w[i : i + 6]) in h for i in range(len(w) - 5))

    got = retrieval.relevance(spark.createDataFrame(answers, "c int, query_id long, answer string"), spark.createDataFrame(chunks, "c int, chunk_id long, text string"), "c")
    assert {tuple(x) for x in got.collect()} == {(q, c) for _, q, a in answers for _, c, t in chunks if holds(a, t)}


def test_inspection(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, chunk_id long, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 7), (2, 1)], "query_id long, chunk_id long")
    got = {r.query_id: r for r in retrieval.inspection(ranked, relevant).collect()}
    assert (got[1].missed, got[1].extra, got[2].missed) == ([7], [5], [1])


class Failing(scoring.HashScorer):
    def score(self, texts):
        raise RuntimeError("down")


def test_scorer_runs(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "row_id long, text string")
    out = scoring.parsed(scoring.scored(rows, scoring.HashScorer(fail_every=5))).collect()
    assert len(out) == 50 and 0 < sum(not r.parse_ok for r in out) < 25 and all(r.score in (-1, 0, 1, None) for r in out)
    bad = scoring.scored(rows, Failing()).collect()
    assert all(r.raw is None and r.error == "RuntimeError: down" for r in bad)
    batched = scoring.batches(rows.withColumn("g", F.lit(1)), 20, "g", "row_id")
    answers = spark.createDataFrame([(1, 0, '```json\n[{"id": 3, "score": 1}, {"id": 4, "score": 9}]\n```'), (1, 1, "junk")], "g int, batch long, raw string")
    told, left = scoring.grouped_answers(batched, answers, "g")
    assert [(r.row_id, r.score) for r in told.collect()] == [(3, 1)] and left.count() == 49
    assert scoring.call_summary(rows, answers).first().reduction_percent == 96.0
    spans = one(spark, scoring.answer_span(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.1), F.lit(0.9)), F.array(*map(F.lit, "abc"))), scoring.answer_span(F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(0.9), F.lit(0.1)), F.array(*map(F.lit, "ab"))))
    assert tuple(spans) == ("b c", "No Answer")


def test_two_stage_and_graded_retrieval(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "row_id long, text string")
    rubrics = spark.createDataFrame([(f"t{k}", f"rubric {k}") for k in range(7)], "topic string, rubric string")
    assert scoring.two_stage(rows, scoring.HashScorer("a"), scoring.HashScorer("b"), rubrics).count() == 10
    chunks = spark.createDataFrame([(i, f"chunk {i}") for i in range(12)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "who"), (2, "what")], "query_id long, query string")
    got = scoring.graded_retrieval(q, lambda x: x.crossJoin(chunks).select("query_id", "chunk_id", F.concat_ws(" ", "query", "text").alias("text")), scoring.HashScorer("g"))
    assert {r.query_id for r in got.collect()} <= {1, 2} and got.count() > 0


def test_upper_median(spark):
    for values in ([5], [1, 2], [3, 1, 2, 9], [4, 4, 4, 1, 9, 9]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert documents.upper_median(df, "v").first().upper_median == sorted(values)[len(values) // 2]


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted(tuple(r) for r in paired.average_ranks(df, "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]




def test_vector_search_in_blocks(spark):
    r = random.Random(6)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = v.where("chunk_id < 9").toDF("query_id", "query_vector")
    whole, parts = (sorted(tuple(x) for x in retrieval.vector_search(q, v, 5, block=b).collect()) for b in (100, 2))
    assert whole == parts and len(whole) == 45
