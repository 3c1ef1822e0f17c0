import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from clausemill.llm import pii
from clausemill.llm.columns import running
from clausemill.llm.query_pii import op10_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.find_personal_data(df).collect()}


def test_base_spans_on_odd_texts(spark):
    r = random.Random(4)
    parts = ["a@b.c", "+x@d.e.f", "@", ".", "1.2.3.4", "256.1.1.1", "0255.1.01.9", "1.2.3.4.5.6.7.8.9", "4111 1111-1111 1111", "4111111111111111", "+1 (755) 555-3798", "+12", "é", " ", "-", "5", "\n", "😀", "(", "x", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "1" * 40_000, "1 " * 30_000, "a" * 60_000 + "@", "+" + "1 (" * 20_000, "1.2.3.4 " * 2_000, "😀 a@b.c 😀 10.0.0.1"]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == base(t), (t or "")[:80]


def test_pre_tests_are_implied_by_the_patterns(spark):
    phone = "+4 - 9 - 1 - 5 - 1 - 2 - 3 - 4 - 5"
    texts = [phone, f"é {phone} (", "x +4   9   1   5   1   2   3   4   5 y", "fe80::1", "2001::5", "a::b"]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == base(t), t
    assert [(s.kind, s.start, s.end) for s in got[0].base] == [("phone", 0, len(phone))]
    spans = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", *[F.transform(pii.candidates(F.col("text"), k), lambda c: c["start"]).alias(k) for k in pii.KINDS]).collect()
    assert {r.i: r.ip for r in spans} == {0: [], 1: [], 2: [], 3: [0], 4: [0], 5: [0]}
    r = random.Random(9)
    parts = ["+", "1", "23", " - ", "  ", "(", ").", "::", ":", "fe", "a", "[.]", ".", "@", " (at) ", "{ dot }", "é", "x", "4111"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(2, 18))) for _ in range(1500)]
    missed = spark.createDataFrame([(t,) for t in made], "t string")
    for k in pii.KINDS:
        assert missed.where((F.col("t").rlike(pii.BASE[k]) | F.col("t").rlike(pii.WIDE[k])) & ~F.col("t").rlike(pii.NEEDS[k])).collect() == []


def test_overlaps_against_all_pairs(spark):
    r = random.Random(6)
    spans = lambda n: sorted((a, a + r.randint(1, 12)) for a in (r.randint(0, 150) for _ in range(n)))
    rows = [(spans(r.randint(0, 17)), spans(r.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<struct<start:long,end:long>>, b array<struct<start:long,end:long>>")
    got = df.select("a", "b", F.transform("b", lambda x: pii.touched(pii.reach_of(F.col("a")), x)).alias("t"), running(F.transform("a", lambda x: x["start"]), lambda v, w: v + w).alias("s")).collect()
    for row in got:
        assert list(row.t) == [any(x.start < y.end and y.start < x.end for x in row.a) for y in row.b]
        assert list(row.s) == [sum(x.start for x in row.a[: i + 1]) for i in range(len(row.a))]


def test_time_grows_in_proportion_to_matches(spark):
    """32,000 matches in one text: base spans exact, and far from the 16-fold time that all pairs would take."""
    parts = lambda n: " ".join(f"u{i}@x.org 10.{i % 256}.0.1 4111 1111 1111 {i % 10000:04d}" for i in range(n))
    took = {}
    for n in (2_000, 2_000, 8_000):
        text = parts(n)
        began = time.time()
        row = found(spark, [text])[0]
        took[n] = time.time() - began
        assert [(s.kind, s.start, s.end) for s in row.base] == base(text)
        both = sorted((s.start, s.end, s.kind) for s in [*row.base, *row.added])
        for a in row.added:
            assert not any(b.start < a.end and a.start < b.end for b in row.base[:50])
        assert len(set(both)) == len(both)
    assert took[8_000] < 10 * took[2_000] + 5


def test_added_spans_do_not_touch_base_spans(spark):
    texts = ["call 4111111111111111 4111111111111111 now", "mail jane (at) example (dot) com please", "phone: (663) 555-6869 today", "token = 2669109448945250", "x 1234567812345678 y"] * 3
    got = found(spark, texts)
    for i, t in enumerate(texts):
        for a in got[i].added:
            assert all(a.end <= b.start or b.end <= a.start for b in got[i].base), t
    assert len(got[0].added) == 2 and {a.kind for a in got[0].added} == {"card"}


def test_label_model_recovers_reliabilities_and_ranks_held_out_spans():
    r = random.Random(1)
    shares = lambda y, name: ((0.95, 0.05, 0) if name == "valid" else (0.8, 0.1, 0.1)) if y else (0.1, 0.2, 0.7)
    votes_of = lambda y: tuple(r.choices((1, 0, -1), shares(y, name))[0] for name in pii.VOTES)
    counts, truth = {}, []
    for _ in range(3000):
        y = r.random() < 0.3
        v = votes_of(y)
        counts[v] = counts.get(v, 0) + 1
        truth.append((y, v))
    share, rate = pii.label_model(sorted(counts.items()))
    assert abs(share - 0.3) < 0.1
    held_out = [(y, pii.posterior(votes_of(y), share, rate) > 0.5) for y in (True, False) * 500]
    assert sum(a == b for a, b in held_out) >= 950
    w = pii.span_classifier([(pii.features(v, (0, 0, 0, 0)), pii.posterior(v, share, rate), n) for v, n in sorted(counts.items())])
    right = sum((sum(a * b for a, b in zip(w, pii.features(v, (0, 0, 0, 0)), strict=True)) > 0) == y for y, v in truth)
    assert right >= 0.95 * len(truth)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.c", "keep", 5)], "doc_id long, text string, base string, start long")
    row = pii.find_personal_data(df).first()
    assert row.start == 5 and row.base[0].kind == "email"
    assert pii.find_personal_data(df.limit(0)).collect() == []
    assert pii.fit([]) == {k: [0.0] * 15 for k in pii.KINDS}


def test_query_digest(spark, sf_dir):
    got = {r.doc_id: r for r in op10_pii(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        spans = base(r.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(k == "card" for k, _, _ in spans)
        assert {x for x in text.split(",") if x} <= set(got[r.doc_id].spans.split(","))
