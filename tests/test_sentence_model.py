"""The sentence model against a plain loop over lists of tokens, and what it changes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausemill.operators import documents, sentence_model
from clausemill.plans.catalog import QUERIES

NUMBER = "##number##"


def token(raw):
    bare = re.sub(r"""["')\]}»”’,;:]+$""", "", re.sub(r"""^["'(\[{«“‘„]+""", "", raw))
    kind = re.sub(r"\.+$", "", bare).lower()
    return {
        "type": NUMBER if re.match(r"^[+-]?\d[\d.,:-]*$", kind) else kind, "stop": bool(re.search(r"[^.]\.$", bare)), "dots": bare.endswith(".."), "mark": bare.endswith(("!", "?")),
        "upper": bare[:1].isupper(), "lower": bare[:1].islower(),
    }


def ratio(both, first, second, total):
    def told(k, n, q):
        return (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n - k else 0)

    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    return -2 * (told(both, first, p) + told(second - both, total - first, p) - told(both, first, p1) - told(second - both, total - first, p2))


def plain_fit(texts):
    lists = [[t for t in map(token, (x or "").split()) if t["type"]] for x in texts]
    flat = [t for ts in lists for t in ts]
    with_, n = Counter(t["type"] for t in flat if t["stop"]), Counter(t["type"] for t in flat)
    total, share = len(flat), sum(with_.values()) / len(flat)
    short = {}
    for w, k in with_.items():
        wo, letters = n[w] - k, len(w.replace(".", ""))
        ll = -2 * (k * math.log(share) + wo * math.log(1 - share) - k * math.log(0.99) - wo * math.log(0.01))
        score = ll * math.exp(-letters) * (len(w) - letters + 1) * letters**-wo if letters else 0
        if re.search(r"[^\W\d_]", w) and score >= 0.3:
            short[w] = score
    pairs = Counter()
    for ts in lists:
        for a, b in zip(ts, ts[1:], strict=False):
            if a["stop"] or a["mark"]:
                pairs[a["type"], b["type"], a["stop"]] += 1
    sure = sum(k for (a, _, stop), k in pairs.items() if not (stop and a in short))
    after = Counter()
    for (a, b, stop), k in pairs.items():
        if not (stop and a in short):
            after[b] += k
    word = re.compile(r"^(?:[^\W\d_]|['’-])+$")
    starters = {b for b, k in after.items() if word.match(b) and ratio(k, sure, n[b], total) >= 30 and k * total > n[b] * sure}
    held = {(a, b) for (a, b, stop), k in pairs.items() if stop and (a in short or a == NUMBER or re.match(r"^[^\W\d_]$", a)) and word.match(b) and b not in starters and ratio(k, with_[a], n[b], total) >= 7.88 and k * total > with_[a] * n[b]}
    return short, starters, held


def plain_sentences(text, model):
    short, starters, held = model
    pieces = re.findall(r"\S+\s*", (text or "").strip())
    out, now = [], ""
    for i, p in enumerate(pieces):
        now += p
        if i + 1 == len(pieces):
            break
        t, f = token(p.strip()), token(pieces[i + 1].strip())
        end = t["mark"]
        if not end and t["dots"]:
            end = f["upper"]
        elif not end and t["stop"]:
            if (t["type"], f["type"]) in held:
                end = False
            elif t["type"] in short or re.match(r"^[^\W\d_]$", t["type"]):
                end = f["upper"] and f["type"] in starters
            else:
                end = not f["lower"] if t["type"] == NUMBER else True
        if end:
            out.append(now.strip())
            now = ""
    return out + ([now.strip()] if now.strip() else [])


def corpus():
    r = random.Random(4)
    names, words = ["Smith", "Jones", "Brown"], ["agrees", "pays", "uses", "reads", "keeps", "data", "terms", "fees", "often"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(r.randint(2, 8)):
            start = r.choice(["The", "However", "We", "You", "It"])
            middle = " ".join(r.choice(words) for _ in range(r.randint(2, 6)))
            parts.append(r.choice([f"{start} {middle} {r.choice(words)}.", f"{start} {middle} by Dr. {r.choice(names)} {r.choice(words)}.", f"{start} {middle}, e.g. {r.choice(words)}!", f"(See No. {r.randint(1, 9)}. {r.choice(words)} etc.)"]))
        texts.append(" ".join(parts))
    return texts + [None, "", "   ", "No stop at all", "Wait... The end. 3. items", "Why? Because."]


def test_fit_and_sentences_against_a_plain_loop(spark):
    texts = corpus()
    model = sentence_model.fit(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    short, starters, held = want = plain_fit(texts)
    rows = model.table.collect()
    assert {r.first for r in rows if r.kind == "starter"} == starters and {(r.first, r.second) for r in rows if r.kind == "collocation"} == held
    assert {r.first: pytest.approx(r.score, rel=1e-6) for r in rows if r.kind == "abbreviation"} == short and {"dr", "e.g"} <= set(short) and "however" in starters
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", model.sentences(F.col("text")).alias("s")).collect()}
    assert got == {k: plain_sentences(t, want) for k, t in enumerate(texts)}
    rule = {r.doc_id: r.n for r in df.select("doc_id", F.size(documents.sentences(F.trim(F.coalesce("text", F.lit(""))))).alias("n")).collect()}
    assert sum(len(got[k]) < rule[k] for k in got) > 100  # the rule ends sentences behind Dr.
    long = spark.createDataFrame([(1, " ".join(texts[:40][k] for k in range(40)))], "doc_id long, text string")
    pieces = documents.document_chunks(long, split=model.sentences, limit=30)
    assert pieces.count() > 10 and not pieces.where(F.col("text").endswith("Dr.")).count()


def test_models_of_nothing_and_of_too_much(spark):
    empty = sentence_model.fit(spark.createDataFrame([(None,), ("",)], "text string"))
    assert empty.table.count() == 0
    assert spark.sql("SELECT 'A big one. C d' AS t").select(empty.sentences(F.col("t")).alias("s")).first().s == ["A big one.", "C d"]
    model = sentence_model.fit(spark.createDataFrame([(t,) for t in corpus()], "text string"))
    with pytest.raises(ValueError, match="entries"):
        sentence_model.SentenceModel(model.table, most=1).sets()


def test_query_against_a_plain_loop(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = plain_fit(docs.values())
    got = {r.doc_id: r.n_model for r in QUERIES["sentence_counts"](spark, sf_dir).collect()}
    want = {k: len(plain_sentences(t, model)) for k, t in docs.items()}
    assert got == want


def test_texts_are_read_once_and_only_distinct_words_are_tokens(spark, monkeypatch):
    texts = ["Dr. Who (the) ... left; He said No.,\x0band 3. \"went\" ?! a b."] * 50 + ["... ( .", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    rows = sentence_model._counted(iter([__import__("pyarrow").RecordBatch.from_pydict({"text": texts})]))
    told = {(r["word"], r["following"]): r["n"] for b in rows for r in b.to_pylist()}
    assert told["Dr.", None] == 50 and told["Dr.", "Who"] == 50 and told["No.,", "and"] == 50 and told["?!", "a b."] == 50
    assert not {"...", "(", "."} & {w for w, _ in told} and sum(n for (_, f), n in told.items() if f is None) == 50 * 12
    # the same words as the engine's tokens
    plain = df.select(F.explode(sentence_model.tokens(F.col("text"))).alias("t")).groupBy("t.type").count()
    counted = spark.createDataFrame([(w, n) for (w, f), n in told.items() if f is None], "w string, n long").groupBy(sentence_model.token(F.col("w"))["type"].alias("type")).agg(F.sum("n").alias("count"))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in counted.collect()}
    model = sentence_model.fit(spark.createDataFrame([(t,) for t in corpus()], "text string"))
    both = df.union(spark.createDataFrame([(t,) for t in corpus()], "text string")).select(model.count(F.col("text")).alias("n"), F.size(model.sentences(F.col("text"))).alias("m"))
    assert not both.where("n != m OR n IS NULL").count()
