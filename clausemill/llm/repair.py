"""Repair of conversation structure, solved once for each distinct signature.

A conversation's rows in order of turn become a string, one letter a row: the class of the role's first character
(``s``, ``u``, ``a``, else ``o``), in capitals where the text breaks off, or ``x`` where the row has to go (blank, or
said before). The cheapest edits depend on that string alone, so each distinct one is solved once and the solution is
joined back; then the edits are replayed on the conversation's own rows.

The repaired roles are to be nothing, or an optional system turn and pairs of user and assistant. Edits: ``K`` keeps a
row (0), ``R`` gives it the role that its place asks for (1), ``D`` deletes it (2), ``I`` inserts an empty turn (5); a
row that breaks off and stays adds 5. A segment of a signature is a table: for each state before and after it the
cheapest edits. The table of a segment is made from those of its halves, by a recursion that remembers short segments
across signatures. Of equal cost the least string in ASCII is taken; two strings of one segment, states and cost are
never prefixes of each other (an insertion costs), so least parts make the least whole.

Defined results for odd input: a null role, text or turn counts as one blank, an empty one or a null as no known
role and a blank text; null turns come first and count in no gap; rows of one turn are ordered by role and text; a
null conversation id is a conversation; bytes that are not UTF-8 become U+FFFD; a conversation whose rows are all
marked as absent is told with zeros and no turns; an empty table gives an empty table; other columns are ignored. A
conversation is one row while it is repaired, as the repaired text of one conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.columns import picked, utf8
from clausemill.llm.store import Store

#: States between rows: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which state a role leads to from each state, and how many insertions lead from one state to another.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INSERTED = {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1} | {(q, q): 0 for q in range(4)}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
ROLES = {USER: "user", ASSISTANT: "assistant"}

Table = dict[tuple[int, int], tuple[int, str]]
#: Signature segments up to this length are remembered, so many of them at most.
SHORT, REMEMBERED = 32, 50_000


def _joined(a: Table, b: Table) -> Table:
    out: Table = {}
    for (q, mid), (c1, e1) in a.items():
        for end in range(4):
            if (mid, end) in b:
                c2, e2 = b[mid, end]
                best = out.get((q, end))
                if best is None or (c1 + c2, e1 + e2) < best:
                    out[q, end] = (c1 + c2, e1 + e2)
    return out


_INSERTS: Table = {k: (INSERT * n, "I" * n) for k, n in INSERTED.items()}


def _row(letter: str) -> Table:
    """The table of one row, without insertions."""
    out: Table = {(q, q): (DELETE, "D") for q in range(4)}
    if letter == "x":
        return out
    more = CUT_OFF if letter.isupper() else 0
    for q in range(4):
        out[q, NEXT[q]] = (REROLE + more, "R")
    for q, to in STEPS.get(letter.lower(), {}).items():
        out[q, to] = min(out.get((q, to), (99, "")), (more, "K"))
    return out


def _table(segment: str) -> Table:
    if not segment:
        return _INSERTS
    if len(segment) == 1:
        return _joined(_joined(_INSERTS, _row(segment)), _INSERTS)
    half = len(segment) // 2
    return _joined(_known(segment[:half]), _known(segment[half:]))


_short = lru_cache(REMEMBERED)(_table)


def _known(segment: str) -> Table:
    return _short(segment) if len(segment) <= SHORT else _table(segment)


def solve(signature: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair; of equal cost the least string."""
    table = _known(signature)
    return min(table[START, q] for q in (START, ASSISTANT) if (START, q) in table)


_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_BLANK = " \t\n\x0b\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def coded(rows: list[dict]) -> tuple[str, dict[str, int]]:
    """The signature of a conversation's rows in order, and what is wrong with them."""
    letters, seen, before = [], set(), None
    n = dict.fromkeys(COUNTS, 0)
    for r in rows:
        role, text = r["role"], r["text"]
        initial, bare = role[:1], text.rstrip(_BLANK)
        letter = initial if initial in ("s", "u", "a") else "o"
        if not bare:
            n["blank"] += 1
            letter = "x"
        elif (role, text) in seen:
            n["duplicate"] += 1
            letter = "x"
        elif bare[-1] not in ".!?":
            n["truncated"] += 1
            letter = letter.upper()
        seen.add((role, text))
        letters.append(letter)
        n["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
    turns = {r["turn"] for r in rows if r["turn"] is not None}
    if turns:
        n["gaps"] = max(turns) - min(turns) + 1 - len(turns)
    return "".join(letters), n


def replay(rows: list[dict], audit: str) -> list[dict[str, str]]:
    """The turns that the edits make of the rows."""
    out, state, at = [], START, 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = rows[at]["role"], rows[at]["text"]
            state = STEPS[role[:1]][state]
        else:
            state = NEXT[state]
            role, text = ROLES[state], rows[at]["text"] if edit == "R" else ""
        at += edit != "I"
        out.append({"role": role, "text": text})
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [coded(r) for r in batch.column("rows").to_pylist()]
        counts = [pa.array([n[c] for _, n in told], pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in told], pa.string()), *counts], names=[*batch.schema.names, "signature", *COUNTS])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in told], pa.int64()), pa.array([e for _, e in told], pa.string())], names=["signature", "cost", "audit"])


def _replay(names: list[str]):
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replay(r, a) for r, a in zip(batch.column("rows").to_pylist(), batch.column("audit").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(done, kind)], names=[*names, "repaired"])

    return run


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the ``repaired`` turns (role, text).

    ``present`` names a boolean column; rows where it is not true only say that their conversation is there.
    """
    store = Store(turns.sparkSession, "repair")
    there = {} if present is None else {"present": present}
    own = picked(turns, conv_id=conv, turn=turn, role=role, text=text, **there)
    clean = lambda c: utf8(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    row = F.struct(F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"))
    rows = F.sort_array(F.collect_list(F.when(F.col("present"), row) if there else row)).alias("rows")
    grouped = own.groupBy("conv_id").agg(rows)
    schema = T.StructType([*grouped.schema.fields, T.StructField("signature", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
    # written: the signatures and the replay read it
    found = store.save(grouped.mapInArrow(_encode, schema), "coded")
    solved = found.select("signature").distinct().mapInArrow(_solve, "signature string, cost long, audit string")
    told = found.join(solved, "signature").select("conv_id", *COUNTS, "cost", "audit", "rows")
    kept = ["conv_id", *COUNTS, "cost", "audit"]
    out = T.StructType([*[told.schema[c] for c in kept], T.StructField("repaired", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))])
    return told.mapInArrow(_replay(kept), out)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) with faults by a hash of conversation and turn; ``present`` is false for those dropped.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes the sentence ends out of it,
    3 repeats it, 4 makes it a user's. Nulls count as one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = picked(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    told = own.select("conv_id", "turn", blank("role").alias("role"), utf8(blank("text")).alias("text"), fault.alias("fault"))
    return told.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("present"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
