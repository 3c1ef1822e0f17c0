"""Subword counts: words cut longest match first by a vocabulary, held as a trie, one for each worker process.

Text is taken as an uncased encoder takes it: lower case, accents off, control characters out, punctuation and CJK
characters as words of their own. A word that the vocabulary cannot cut whole, or of more than ``LONGEST`` characters,
is one unknown token. The vocabulary is a bounded list that is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a word at most, and words whose cuts a worker remembers.
LONGEST, REMEMBERED = 100, 200_000
_END = ""
_RUN = re.compile(r"[^ \t\n\r]+")


def _is_cjk(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0x20000 <= n <= 0x2CEAF or 0xF900 <= n <= 0xFAFF or 0x2F800 <= n <= 0x2FA1F


def _is_mark(c: str) -> bool:
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c).startswith("P")


def words_of(text: str) -> list[str]:
    """The words of a text in the form that the vocabulary knows."""
    out = []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or c in "\x00�":
            continue
        if c in " \t\n\r" or kind == "Zs":
            out.append(" ")
        elif kind.startswith("C"):
            continue
        elif _is_mark(c) or _is_cjk(c):
            out.append(f" {c} ")
        else:
            out.append(c)
    return "".join(out).split()


class Pieces:
    """A vocabulary as two tries: pieces that begin a word, and pieces that go on (written with the ``inner`` mark)."""

    def __init__(self, vocabulary: Iterable[str], inner: str = "##"):
        self.first: dict = {}
        self.further: dict = {}
        self.known: dict[str, int] = {}
        self.seen = _Seen(self._count_run)
        for piece in vocabulary:
            node, rest = (self.further, piece[len(inner) :]) if inner and piece.startswith(inner) and len(piece) > len(inner) else (self.first, piece)
            for c in rest:
                node = node.setdefault(c, {})
            if rest:
                node[_END] = True

    def cut(self, word: str) -> list[str] | None:
        """The pieces of a word, longest first from the left; None where one is missing."""
        out, at = [], 0
        while at < len(word):
            node, stop, k = self.first if at == 0 else self.further, -1, at
            while k < len(word) and (node := node.get(word[k])) is not None:
                k += 1
                if _END in node:
                    stop = k
            if stop < 0:
                return None
            out.append(word[at:stop])
            at = stop
        return out

    def count(self, text: str) -> int:
        return sum(map(self.seen.__getitem__, _RUN.findall(text)))

    def _count_run(self, run: str) -> int:
        n = 0
        for w in words_of(run):
            found = self.known.get(w)
            if found is None:
                pieces = self.cut(w) if len(w) <= LONGEST else None
                found = len(pieces) if pieces else 1
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[w] = found
            n += found
        return n


class _Seen(dict):
    """The counts of runs between blanks, as they stand: no step of ``words_of`` looks over a blank."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.count(run)
        if len(run) <= LONGEST:
            self[run] = found
        return found


_WORKER: dict[str, Pieces] = {}


def vocabulary_of(path: str) -> list[str]:
    """The pieces of a vocabulary file: one a line, or the JSON of a byte-pair vocabulary with word ends, whose tokens both begin words and go on."""
    if not path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return [x.rstrip("\n") for x in f if x.strip()]
    with open(path, encoding="utf-8") as f:
        tokens = {t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"]}
    return sorted({p for t in tokens if t for p in (t, f"##{t}")})


def counter(spark: SparkSession, vocabulary: Iterable[str], inner: str = "##") -> Callable[[Column], Column]:
    """A function of columns of texts in lists of lists to their counts, for ``documents.subword_chunks``; null texts count 0."""
    pieces = sorted(set(vocabulary))
    name = hashlib.sha256("\n".join([inner, *pieces]).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def counted(lists):
        import pandas as pd

        if name not in _WORKER:
            _WORKER[name] = Pieces(shared.value, inner)
        own = _WORKER[name]
        return pd.Series([None if row is None else [[0 if t is None else own.count(t) for t in texts] for texts in row] for row in lists])

    return counted


def subword_count(count: Callable[[Column], Column], text: Column) -> Column:
    """The count of one text."""
    return count(F.array(F.array(text)))[0][0]
