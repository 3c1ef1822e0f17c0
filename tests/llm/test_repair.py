"""Conversation repair: the recursion against all edit strings, the query against a plain loop."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clausemill.llm.query_repair import op11_conversation_repair
from clausemill.llm.repair import repair_conversations, replay, solve

GOOD = re.compile(r"(s?(ua)+)?")


def plain_solve(signature):
    """All edit strings with at most three insertions, by cost and then by letter."""
    best = None
    n = len(signature)
    for inserts in range(4):
        for places in itertools.combinations(range(n + inserts), inserts):
            for edits in itertools.product("DKR", repeat=n):
                it, ed, audit, cost, roles = iter(signature), iter(edits), "", 0, ""
                for k in range(n + inserts):
                    if k in places:
                        audit, cost, roles = audit + "I", cost + 5, roles + "?"
                        continue
                    letter, e = next(it), next(ed)
                    audit += e
                    if letter == "x" and e != "D":
                        break
                    cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if letter.isupper() and e != "D" else 0)
                    roles += {"D": "", "K": letter.lower(), "R": "?"}[e]
                else:
                    if any(GOOD.fullmatch("".join(x)) for x in itertools.product(*["ua" if c == "?" else c for c in roles])):
                        best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_recursion_finds_the_cheapest_and_least_edits():
    for n in range(4):
        for s in itertools.product("suoxUA" if n == 3 else "suaoxUAS", repeat=n):
            assert solve("".join(s)) == plain_solve("".join(s)), s
    dice = random.Random(3)
    for _ in range(12):
        s = "".join(dice.choice("ssuuaaoxUAS") for _ in range(4))
        assert solve(s) == plain_solve(s), s


def test_long_signatures_are_solved_in_proportion():
    dice = random.Random(5)
    s = "".join(dice.choice("suuaaoxUA") for _ in range(20_000))
    cost, audit = solve(s)
    rows = [{"role": {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "other"), "text": "t."} for c in s]
    assert sum(e != "I" for e in audit) == len(s)
    assert GOOD.fullmatch("".join(t["role"][0] for t in replay(rows, audit)))
    price = {"D": 2, "K": 0, "R": 1, "I": 5}
    at, told = 0, 0
    for e in audit:
        told += price[e] + (5 if e in "KR" and s[at].isupper() else 0)
        at += e != "I"
    assert told == cost


def plain(rows):
    """The contract's columns of (conv_id, turn, role, text) rows, by a forward table of strings."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = duplicate = truncated = 0
        states = {"": (0, "", [])}
        for i, (_, role, text) in enumerate(own):
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            b, d = not last, (role, text) in [(r[1], r[2]) for r in own[:i]]
            t = bool(last) and not d and last[0] not in ".!?"
            blank, duplicate, truncated = blank + b, duplicate + (d and not b), truncated + t
            states = spread(states)
            new = {}
            for s, (c, e, kept) in states.items():
                put(new, s, c + 2, e + "D", kept)
                if not (b or d):
                    for kind, own_role, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                        to = step(s, own_role[:1])
                        if to:
                            put(new, to, c + price + 5 * t, e + kind, [*kept, f"{own_role}:{text}"])
            states = new
        states = spread(states)
        cost, audit, kept = min(states[s] for s in ("", "a") if s in states)
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def put(states, s, cost, audit, kept):
    if s not in states or (cost, audit) < states[s][:2]:
        states[s] = (cost, audit, kept)


def spread(states):
    for _ in range(3):
        for s, (c, e, kept) in list(states.items()):
            for role in ("user", "assistant"):
                if to := step(s, role[0]):
                    put(states, to, c + 5, e + "I", [*kept, f"{role}:"])
    return states


def told(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_a_plain_loop(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"/root/testdata/{sf}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    want = plain(rows)
    assert len(want) > 10 and told(op11_conversation_repair(spark, f"/root/testdata/{sf}")) == want


def test_odd_rows(spark):
    dice = random.Random(11)
    texts = [None, "", " \t", "Done.", "Cut", "Yes!", "Was it?  ", "x" * 50_000, " ", "é."]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(dice.randrange(0, 9)):
            rows.append((conv, dice.choice([None, 0, 1, 2, 5, 9]), dice.choice(["user", "assistant", "system", None, "", "tool", "User"]), dice.choice(texts)))
    rows += rows[:30]
    rows += [(77, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", F.lit("clash").alias("ROLE"), F.lit(1).alias("rows"), F.lit(2).alias("Present"))
    assert op11_like(df) == plain(rows)


def op11_like(df):
    from clausemill.llm.repair import COUNTS, damaged

    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return told(repair_conversations(damaged(df), present="present").select("conv_id", *COUNTS, "cost", "audit", F.sha2(said, 256).alias("repaired_sha256")))


def test_operator_on_its_own(spark):
    schema = "c string, t int, who string, said string"
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hi."), ("b", 4, "assistant", "Well."), ("b", 2, "system", "Be kind.")]
    out = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, schema), "c", "t", "who", "said").collect()}
    assert [(t.role, t.text) for t in out["b"].repaired] == [("user", "Be kind."), ("assistant", "Well.")] and out["b"].audit == "RK" and out["b"].gaps == 1
    assert out["a"].duplicate == 1 and out["a"].audit == "DD" and out["a"].cost == 4
    bad = spark.sql("SELECT 'z' AS c, 0 AS t, 'user' AS who, CAST(X'6f6bff2e' AS STRING) AS said UNION ALL SELECT 'z', 1, 'assistant', 'Fine.'")
    row = repair_conversations(bad, "c", "t", "who", "said").first()
    assert [t.text for t in row.repaired] == ["ok�.", "Fine."] and row.cost == 0
    assert repair_conversations(spark.createDataFrame([], schema), "c", "t", "who", "said").collect() == []
