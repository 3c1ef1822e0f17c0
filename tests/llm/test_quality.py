import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from clausemill.llm.columns import words
from clausemill.llm.quality import Rules, line_first_quality, line_passes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, n_words long, lang string"


def base(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    inside = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_base_counts_against_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t ", "a " * 5000, "x", "|" * 3000, "a\x0bb\x0cc d", "é😀 " * 40, "word " * 7, "word " * 8, "word " * 9]
    for _ in range(150):
        texts.append("".join(r.choice(["a", "b", "cc", "&", "*", "é", "A"]) + r.choice([" ", " ", " ", "\n", "\n\n", "\t", ""]) for _ in range(r.randint(0, 90))))
    rows = [(i, t, "x", 3, "en") for i, t in enumerate(texts)] + [(1, texts[20], "x", 3, "en"), (None, texts[20], None, None, None)]
    out = line_first_quality(spark.createDataFrame(rows, SCHEMA))
    assert out.columns[:3] == ["doc_id", "text", "lang"] and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for g in got:
        want = base(g.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, g.text
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g.kept and g.base_failed)
    assert line_first_quality(spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_rules(spark):
    good = ["A plain sentence that ends as it should.", "No stop but long enough to be a line of text", "", "   ", "Of.", "He said \"yes\"", "The EU and the USA signed it in 1995.", "Licensed under the Apache License, Version 2.0."]
    bad = ["Home | News | Sport | Contact | Login", "Read more", "&&& *** $$$ ### word", "CLICK!! HERE!! NOW!! TO!! WIN!!", "THE WHOLE LINE IS SHOUTED AT THE READER", "buy " * 15, "We use cookies to improve your visit.", "© 2020 All rights reserved."]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.select(line_passes(F.col("t"), words(F.col("t")), Rules())).collect()] == [True] * len(good) + [False] * len(bad)


def test_verdict_and_clean_text(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    prose = "\n".join("The " + " ".join(word() for _ in range(9)) + "." for _ in range(6))
    menu = "Home | News | Sport | Contact | Login | Register"
    rows = [(1, prose, "", 0, ""), (2, menu + "\n" + prose + "\nRead more", "", 0, ""), (3, prose.split("\n")[0] + "\n" + "\n".join(" | ".join(word() for _ in range(7)) for _ in range(5)), "", 0, "")]
    got = {r.doc_id: r for r in line_first_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[1].kept_share == 1.0
    assert got[2].kept and got[2].clean_text == prose
    assert not got[3].kept and not got[3].base_failed
