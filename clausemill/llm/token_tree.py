"""Edit-aware token counts: a segment tree of token counts over each document's text.

The leaves are pieces of the text, cut only between a visible character and a blank. No pre-token of a
byte-level vocabulary spans such a place, whatever stands further left or right, so the counts of the leaves
add up to the count of the text. Each inner node holds the sums of characters and tokens below it. An edit
finds its leaves by the sums of characters, encodes again the text of those leaves, and takes a neighbour in
as context where the edit has spoiled a cut; then the sums above change. Leaves that have grown are split
when the tree is built anew, which their number bounds.

The tree outlives the call: on request the rows come back with the edited text and its ``tree``, the characters
and tokens of each leaf and a hash of the text. Rows that bring their tree are not encoded again but where edits
touch them, so a job over a batch of edits costs what the edits touch. A tree whose hash is not that of the text
is built anew.

Documents are independent rows: nothing is shuffled but where an edit log is joined.

Defined results for odd input: a null text counts as empty and has no token; places outside the text are moved
to its nearest end; a null replacement is empty; bytes that are not UTF-8 become U+FFFD, in texts and replacements; edits apply in order, each to the text the one before left;
equal rows give equal results, row by row; an empty table gives an empty table; other columns pass through
untouched, whatever their names, but for those named as an added one in any case of letters, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.columns import Passing, picked, utf8
from clausemill.llm.tokenizer import coder, vocabulary

_CUT = re.compile(r"(?<=[!-~\w])(?=[ \n\t\r])")
EDIT = "struct<start:long,length:long,replacement:string>"
TREE = "struct<text_hash:long,chars:array<int>,tokens:array<int>>"


def text_hash(text: str) -> int:
    """A signed 64-bit hash of a text."""
    found = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return found - (1 << 64) if found >= 1 << 63 else found


def leaves_of(text: str, size: int) -> list[str]:
    """The text in pieces of about ``size`` characters, cut only where no pre-token can span."""
    found, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size)
        end = m.start() if m else len(text)
        found.append(text[at:end])
        at = end
    return found


class TokenTree:
    """The token count of a text under edits."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = 256, stored: dict | None = None):
        self.count, self.size = count, size
        self.encoded = 0
        if stored and stored["text_hash"] == text_hash(text) and sum(stored["chars"]) == len(text):
            ends = [0, *accumulate(stored["chars"])]
            self._fill([(text[a:b], n) for a, b, n in zip(ends[:-1], ends[1:], stored["tokens"], strict=True)])
        else:
            self._fill([(x, self._encode(x)) for x in leaves_of(text, size)])

    def stored(self) -> dict:
        """The tree as TREE: its leaves with text, in order."""
        own = [k for k, x in enumerate(self.leaves) if x]
        return {"text_hash": text_hash(self.text()), "chars": [len(self.leaves[k]) for k in own], "tokens": [self.tokens[self.width + k] for k in own]}

    def _encode(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece) if piece else 0

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = self.width + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, or the last one with text, and where the leaf starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def _near(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.width and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.width else None

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = max(0, min(start, self.length))
        length = max(0, min(length, self.length - start))
        first, at = self._find(start)
        last, _ = self._find(max(start, start + length - 1))
        whole = "".join(self.leaves[first : last + 1])
        new = whole[: start - at] + replacement + whole[start - at + length :]
        while (left := self._near(first, -1)) is not None and not (new and _CUT.match(self.leaves[left][-1] + new, 1)):
            first, new = left, self.leaves[left] + new
        while (right := self._near(last, 1)) is not None and not (new and _CUT.match(new[-1] + self.leaves[right], 1)):
            if not new and self._near(first, -1) is None:
                break
            last, new = right, new + self.leaves[right]
        pieces = leaves_of(new, self.size) if new else []
        if len(pieces) > 4 * (last - first + 1) + 4:  # much text came in: cut it up and build the tree anew
            known = [(x, self.tokens[self.width + k]) for k, x in enumerate(self.leaves) if x and not first <= k <= last]
            before = sum(1 for k, x in enumerate(self.leaves[:first]) if x)
            counts = [(p, self._encode(p)) for p in pieces]
            self._fill(known[:before] + counts + known[before:])
            return
        for k in range(first + 1, last + 1):
            if self.leaves[k]:
                self._put(k, "", 0)
        self._put(first, new, self._encode(new))

    def _fill(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = [x for x, _ in leaves] + [""] * (self.width - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (x, n) in enumerate(leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = len(x), n
        for k in range(self.width - 1, 0, -1):
            self._sum(k)


ADDED = ("n_tokens", "n_leaves", "edited_chars", "edited_tokens", "encoded_again", "encoded_chars")


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str | None = None,
    text: str = "text",
    edits: str | None = "edits",
    leaf: int = 256,
    tree: str = "tree",
    keep_tree: bool = False,
) -> DataFrame:
    """The rows less text, edits and tree, with the counts before and after the edits of column ``edits`` (array of EDIT).

    ``encoded_again`` is how many characters the edits had encoded, ``encoded_chars`` how many the call had, which is
    the same where the rows bring a column ``tree``. With ``keep_tree`` the edited text and its tree are told too,
    under the names of those columns.
    """
    path = vocabulary_path or vocabulary()
    told = [*ADDED, *([text, tree] if keep_tree else [])]
    there = {c.lower() for c in docs.columns}
    given = [c for c in (text, edits, tree) if c and c.lower() in there]
    passing = Passing(docs, told, without=[text, *given])
    at = lambda name, kind: (F.col(passing.inside(name)) if name in given else F.lit(None)).cast(kind)
    clean = lambda e: F.when(e.isNotNull(), F.struct(e["start"].alias("start"), e["length"].alias("length"), utf8(e["replacement"]).alias("replacement")))
    n = len(passing.kept)
    source = passing.inner.select(*passing.kept, utf8(at(text, "string")).alias("text"), F.transform(at(edits, f"array<{EDIT}>"), clean).alias("edits"), at(tree, TREE).alias("tree"))
    kinds = [T.StructField(c, T.LongType()) for c in ADDED] + ([T.StructField(text, T.StringType()), T.StructField(tree, source.schema["tree"].dataType)] if keep_tree else [])
    schema = T.StructType(source.schema.fields[:n] + kinds)
    arrow = [pa.int64()] * len(ADDED) + [pa.string(), pa.struct([("text_hash", pa.int64()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            rows = []
            for value, log, stored in zip(*(batch.column(n + k) for k in range(3)), strict=True):
                one = TokenTree(value.as_py() or "", code.count, leaf, stored.as_py())
                before, size, encoded = one.total, sum(1 for x in one.leaves if x), one.encoded
                for e in log.as_py() or ():
                    if e is not None:
                        one.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                rows.append((before, size, one.length, one.total, one.encoded - encoded, one.encoded, *((one.text(), one.stored()) if keep_tree else ())))
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(told), arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *added], names=schema.names)

    return passing.outer(source.mapInArrow(run, schema), *told)


def with_edits(docs: DataFrame, log: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents with column ``edits``, from an edit log (doc_id, seq, start, length, replacement) in order of seq.

    One document's edits meet in one row. Rows that share an id get the same edits; a null id gets none.
    """
    passing = Passing(docs, ["edits"])
    step = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "replacement")
    per = picked(log, id="doc_id", seq="seq", start="start", length="length", replacement="replacement").groupBy("id").agg(F.sort_array(F.collect_list(step)).alias("log"))
    told = passing.inner.join(per, F.col(passing.inside(doc_id)) == F.col("id"), "left")
    own = F.transform("log", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement")))
    return passing.outer(told.withColumn("edits", F.coalesce(own, F.expr("array()").cast(f"array<{EDIT}>"))), "edits")
