import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm.line_dedup import dedup_lines, find_runs, windows_of, without

SCHEMA = "doc_id long, text string, row string"


def brute(rows, least):
    """For every pair of places the common run; a run with enough words is deleted at its later place."""
    seqs = []
    for _, t, *_ in rows:
        seqs.append([(k, x, len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()])
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))
    gone = [set() for _ in rows]
    for y, b in enumerate(order):
        for a in order[: y + 1]:
            for i in range(len(seqs[b])):
                for j in range(i if a == b else len(seqs[a])):
                    n = words = 0
                    while i + n < len(seqs[b]) and j + n < len(seqs[a]) and seqs[b][i + n][1] == seqs[a][j + n][1]:
                        words += seqs[b][i + n][2]
                        n += 1
                    if n and words >= least:
                        gone[b].update(range(seqs[b][i][0], seqs[b][i + n - 1][0] + 1))
    out = []
    for r, g in zip(rows, gone, strict=True):
        out.append((r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in g), len(g)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=20), st.integers(1, 15))
def test_least_windows(words, least):
    ahead, back = windows_of(np.array(words), least)
    for i in range(len(words)):
        sizes = [n for n in range(1, len(words) - i + 1) if sum(words[i : i + n]) >= least]
        assert ahead[i] == min(sizes, default=0)
        sizes = [n for n in range(1, i + 2) if sum(words[i + 1 - n : i + 1]) >= least]
        assert back[i] == min(sizes, default=0)


def test_against_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        lines = [" ".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(6)] + ["", " "]
        passage = [r.choice(lines) for _ in range(7)]
        rows = []
        for i in range(25):
            own = [r.choice(lines) if r.random() < 0.6 else f"own {seed} {i} {k}" for k in range(r.randint(0, 12))]
            if r.random() < 0.5:
                own[r.randint(0, len(own)) : 0] = passage[r.randint(0, 3) : r.randint(4, 7)]
            rows.append((i * 7 % 25, "\n".join(own), "x"))
        rows += [(3, "\n".join(passage), "x")]
        got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), min_words=5)
        assert got.columns == ["doc_id", "text", "row", "n_deleted"]
        got = sorted((x.doc_id, x.text, x.n_deleted) for x in got.collect() if x.doc_id != 3)
        assert got == sorted(x for x in brute(rows, 5) if x[0] != 3)


def test_long_runs_need_many_rounds(spark):
    run = "\n".join(f"w{i}" for i in range(40))
    rows = [(1, "a\n" + run + "\nb", "x"), (2, "c\n" + run + "\nd", "x"), (3, "e\n" + run.replace("w20", "w"), "x")]
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=33).collect()}
    assert (got[1].n_deleted, got[2].n_deleted, got[3].n_deleted) == (0, 40, 0) and got[2].text == "c\nd"


def test_runs_with_their_common_prefix_and_first_copy(spark):
    run = [f"w{i} x{i}" for i in range(30)]
    texts = {1: ["a", *run, "b"], 2: ["c", "", *run[:12], "", *run[12:], "d"], 3: [*run[5:25], "e"], 4: ["f", *run[:10], "g", *run[20:]], 5: ["own line here"] * 2}
    rows = [(i, "\n".join(t), "x") for i, t in texts.items()]
    got = sorted(tuple(r) for r in find_runs(spark.createDataFrame(rows, SCHEMA).repartition(2), min_words=10).collect())
    # 3 holds a part of the run: its windows occur in 1 first; copies counts the fullest window of each run
    assert [r[:6] for r in got] == [(2, 2, 32, 30, 1, 1), (3, 0, 19, 20, 1, 6), (4, 1, 10, 10, 1, 1), (4, 12, 21, 10, 1, 21)]
    assert all(2 <= r[6] <= 4 for r in got)
    for doc, from_line, to_line, n, first, first_line, _ in got:
        of = lambda d, a: [x for x in texts[d][a:] if x.split()][:n]  # noqa: B023, E731
        assert of(doc, from_line) == of(first, first_line) and len([x for x in texts[doc][from_line : to_line + 1] if x.split()]) == n


def test_nulls_repeated_rows_and_empty(spark):
    text = "one two three\n\nfour five six"
    rows = [(None, None, "x"), (None, text, "x"), (4, text, "x"), (4, text, "x"), (5, "", "x"), (6, " \n ", "x"), (7, "one two three", "x")]
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.text or "", x.n_deleted) for x in dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=4).collect()))
    assert got == [(False, 4, "", 3), (False, 4, text, 0), (False, 5, "", 0), (False, 6, " \n ", 0), (False, 7, "one two three", 0), (True, 0, "", 0), (True, 0, "", 3)]
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    assert without("a\nb\nc\nd", [(1, 2), (0, 1)]) == ("d", 3)


def test_a_later_copy_takes_the_lines_that_it_shares_with_the_first(spark):
    line, other = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(1, "\n".join([line] * 4), "x"), (2, "\n".join([line, other] * 3), "x")]
    got = sorted((x.doc_id, x.text, x.n_deleted) for x in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(brute(rows, 50)) and got[0][1] == line


def test_ids_tell_lines_apart_by_both_halves(spark):
    from clausemill.llm.line_dedup import _lines  # the two halves of one digest, so no line is named by 64 bits alone

    batch = spark.createDataFrame([(0, 1, "a b\nc d")], "row long, doc_id long, text string")
    found = batch.mapInArrow(_lines(50), "row long, doc_id long, i int, id long, more long, ahead int, ahead_from int, ahead_to int, back int, back_from int, back_to int").collect()
    assert len({(r.id, r.more) for r in found}) == 2 and all(r.id != r.more for r in found)


def test_few_names_are_few_files_whatever_the_number_of_shuffle_partitions(spark):
    from clausemill.llm.line_dedup import doubled
    from clausemill.llm.store import Store

    pairs = [(row, i, rank) for row, text in enumerate(["abcab", "bcabx", "cabca", "zab"] * 30) for i, rank in enumerate(map(ord, text))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "67")
    store = Store(spark, "few-names")
    try:
        ranks = doubled(spark.createDataFrame(pairs, "row long, i int, rank long"), 1, store)
        names = spark.read.parquet(f"{store.path}/names-2")
        told = names.orderBy("first", "second").collect()
        assert len(names.inputFiles()) < 8 and [r["rank"] for r in told] == sorted(r["rank"] for r in told)
        assert ranks.count() == sum(len(t) - 1 for t in ["abcab", "bcabx", "cabca", "zab"]) * 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        store.remove()
