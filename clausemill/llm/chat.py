"""Chat formatting with a grammar round trip, in column expressions only.

Grammar of a formatted conversation, one production per turn, nothing between turns::

    turn := "<s>[" TAG "] " TEXT " [/" TAG "]</s>"

TAG is INST for user, ANS for assistant, SYS for system, and any other role written in lower-case hex
after ``ROLE:``. A control string is ``<s>``, ``</s>`` or a bracketed tag. Inside a text every control
string, bare or already carrying backslashes behind its first character, gets one more backslash there,
so ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``; the parser takes one off. The two rewrites
are each other's inverse, and no bare control string is left inside an escaped text, so ``</s>`` can only end a turn.

Every turn is rendered as it is and parsed again; where what comes back differs from the source, its text is escaped.
As a turn's end is also an end for the parser, the turns of a conversation come back as they do alone. The whole
conversation is then parsed and compared with its source; one that still differed would have all its texts escaped
and be compared again, and be marked as not ``faithful`` if it differed then (none is known). A text with a bare control string is not in the grammar.

Defined results for odd input: a null text counts as empty and a null role as the empty role; bytes that are not
UTF-8 become U+FFFD in the source; turns are
ordered by turn number (null first), then role and text; equal rows are kept as turns of their own; rows
with a null conversation id form one conversation; an empty table gives an empty table; other columns are
ignored, also ones whose names differ by case only. The contract asks for one row and one digest a conversation, so one conversation's turns meet in
one row: that, not the table, is what a task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import let, picked, running, utf8

#: The tag of each known role.
TAGS = {"user": "INST", "assistant": "ANS", "system": "SYS"}

_CONTROL = (r"<(\\*)(/?s)>", r"\[(\\*)(/?(?:INST|ANS|SYS|ROLE:[0-9a-f]*))\]")
_ESCAPED = (r"<\\(\\*)(/?s)>", r"\[\\(\\*)(/?(?:INST|ANS|SYS|ROLE:[0-9a-f]*))\]")

_BARE = r"</?s>|\[/?(?:INST|ANS|SYS|ROLE:[0-9a-f]*)\]"


def escape(text: Column) -> Column:
    for pattern, (a, b) in zip(_CONTROL, ("<>", "[]"), strict=True):
        text = F.regexp_replace(text, pattern, rf"{a}\\$1$2{b}")
    return text


def unescape(text: Column) -> Column:
    for pattern, (a, b) in zip(_ESCAPED, ("<>", "[]"), strict=True):
        text = F.regexp_replace(text, pattern, f"{a}$1$2{b}")
    return text


def tag_of(role: Column) -> Column:
    found = F.concat(F.lit("ROLE:"), F.lower(F.hex(F.encode(role, "UTF-8"))))
    for name, tag in TAGS.items():
        found = F.when(role == name, F.lit(tag)).otherwise(found)
    return found


def role_of(tag: Column) -> Column:
    found = F.decode(F.unhex(F.substring(tag, 6, F.length(tag))), "UTF-8")
    for name, known in TAGS.items():
        found = F.when(tag == known, F.lit(name)).otherwise(found)
    return found


def _rendered(role: Column, text: Column) -> Column:
    """One turn, its text taken as it stands."""
    return let(tag_of(role), lambda tag: F.concat(F.lit("<s>["), tag, F.lit("] "), text, F.lit(" [/"), tag, F.lit("]</s>")))


def conflicting(turn: Column) -> Column:
    """Whether a turn, rendered as it is, comes back differently."""
    return ~F.coalesce(parse(_rendered(turn["role"], turn["text"])) == F.array(turn), F.lit(False))


def render(turns: Column, escaped: Column) -> Column:
    """The formatted text of an array of (role, text), the texts escaped where the array of marks says so."""
    one = lambda t, i: _rendered(t["role"], F.when(F.get(escaped, i), escape(t["text"])).otherwise(t["text"]))
    return F.array_join(F.transform(turns, one), "")


def _pieces(formatted: Column) -> Column:
    """The formatted text cut behind each ``</s>``; what follows the last one is a piece too unless empty."""
    cut = F.split(formatted, "</s>", -1)
    return let(cut, lambda p: F.slice(p, 1, F.greatest(F.size(p) - F.when(F.element_at(p, -1) == "", 1).otherwise(0), F.lit(0))))


def _read(piece: Column) -> Column:
    """(tag, raw text, well formed) of one piece without its ``</s>``."""

    def with_tag(tag: Column) -> Column:
        head, tail = F.concat(F.lit("<s>["), tag, F.lit("] ")), F.concat(F.lit(" [/"), tag, F.lit("]"))
        size = F.length(piece) - F.length(head) - F.length(tail)
        framed = piece.startswith(head) & piece.endswith(tail) & (size >= 0)
        raw = F.substring(piece, F.length(head) + 1, F.greatest(size, F.lit(0)))
        return let(raw, lambda r: F.struct(tag.alias("tag"), r.alias("raw"), (framed & ~r.rlike(_BARE)).alias("good")))

    return let(F.regexp_extract(piece, r"\A<s>\[([A-Z]+(?::[0-9a-f]*)?)\] ", 1), with_tag)


def parse(formatted: Column) -> Column:
    """The turns read back: array of (role, text, loss_start, loss_length); null where the text is not in the grammar.

    The loss mask covers the texts of assistant turns as they stand in the formatted text, by code points.
    """

    def of(p: Column) -> Column:
        read = F.transform(p, _read)
        whole = (formatted == "") | formatted.endswith("</s>")
        return let(read, lambda r: F.when(whole & F.forall(r, lambda x: x["good"]), F.transform(r, turn)))

    def turn(x: Column) -> Column:
        return F.struct(role_of(x["tag"]).alias("role"), unescape(x["raw"]).alias("text"))

    return let(_pieces(formatted), of)


def loss_spans(formatted: Column) -> Column:
    """Array of (start, length): the code points of the formatted text under the loss mask."""

    def of(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x) + 4), lambda v, w: v + w)

        def spans(e: Column) -> Column:
            own = F.transform(p, lambda x, i: let(_read(x), lambda r: F.struct(r["tag"].alias("tag"), (F.coalesce(F.get(e, i - 1), F.lit(0)) + F.length(r["tag"]) + 6).alias("start"), F.length(r["raw"]).alias("length"))))
            return F.transform(F.filter(own, lambda s: s["tag"] == TAGS["assistant"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

        return let(ends, spans)

    return let(_pieces(formatted), of)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its id, ``formatted``, ``escaped`` (how many turns), ``turns`` as read back, ``loss_spans``, and
    ``faithful``: whether what is read back equals the source.
    """
    source = (
        picked(turns, conv_id=conv, turn=turn, role=role, text=text)
        .select("conv_id", F.struct("turn", utf8(F.coalesce("role", F.lit(""))).alias("role"), utf8(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    )
    marked = source.withColumn("marks", F.transform("source", conflicting))
    formatted = marked.withColumn("formatted", render(F.col("source"), F.col("marks"))).withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    # the second comparison: none has been seen to need it
    again = formatted.withColumn("same", same).withColumn("marks", F.when(F.col("same"), F.col("marks")).otherwise(F.transform("source", lambda t: F.lit(True))))
    again = again.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("source"), F.col("marks"))))
    again = again.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted"))))
    told = again.withColumn("faithful", same)
    escaped = F.size(F.filter("marks", lambda m: m)).alias("escaped")
    return told.select("conv_id", escaped, "formatted", "faithful", "turns", loss_spans(F.col("formatted")).alias("loss_spans"))
