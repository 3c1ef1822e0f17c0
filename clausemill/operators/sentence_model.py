"""Sentence boundaries from corpus-wide statistics, without labelled text (after Kiss and Strunk, 2006).

Three tables are fitted by aggregates over all tokens, with map-side combining: abbreviations (types that keep company
with a final period: a log-likelihood ratio, scaled by their length, their inner periods and how often they stand
without one), starters (types that follow sure boundaries more often than by chance), and collocations (an abbreviation,
number or initial with the type behind its period). The model is a table; as a column expression it holds its types as
literal sets, which are looked up by hash.

A token that ends in ! or ? ends a sentence; one in dots does before a capital. One in a period does unless it and the
next are a collocation; an abbreviation or an initial does only before a capitalised starter; a number does unless a
small letter follows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.session import written

#: The thresholds of the publication for abbreviations, collocations and starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Marks that may stand around a word, and the type of every number.
_OPEN, _CLOSE, NUMBER = r"""^["'(\[{«“‘„]+""", r"""["')\]}»”’,;:]+$""", "##number##"
_TOKEN = "struct<type:string,stop:boolean,dots:boolean,mark:boolean,upper:boolean,lower:boolean>"


def token(raw: Column) -> Column:
    """(type, stop, dots, mark, upper, lower): the lower-case type without its period, what it ends in, how it begins."""

    def of(t: Column) -> Column:
        stop = t.rlike(r"[^.]\.$")
        bare = F.lower(F.regexp_replace(t, r"\.+$", ""))
        kind = F.when(bare.rlike(r"^[+-]?\p{N}[\p{N}.,:-]*$"), F.lit(NUMBER)).otherwise(bare)
        return F.struct(kind.alias("type"), stop.alias("stop"), t.rlike(r"\.\.$").alias("dots"), t.rlike(r"[!?]$").alias("mark"), t.rlike(r"^\p{Lu}").alias("upper"), t.rlike(r"^\p{Ll}").alias("lower"))

    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), _OPEN, ""), _CLOSE, "")
    return F.transform(F.array(bare), of)[0]


def tokens(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)), token), lambda t: F.length(t["type"]) > 0)


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def association(both: Column, first: Column, second: Column, total: float) -> Column:
    """Dunning's log-likelihood ratio of a pair: how much better two shares tell the second than one."""
    p = second / total
    p1, p2 = both / first, (second - both) / (total - first)

    def told(k: Column, n: Column, q: Column) -> Column:
        return _xlogy(k, q) + _xlogy(n - k, 1.0 - q)

    rest, others = second - both, F.lit(total) - first
    return -2.0 * (told(both, first, p) + told(rest, others, p) - told(both, first, p1) - told(rest, others, p2))


@dataclass
class SentenceModel:
    """The fitted table (kind, first, second, score), and the expression that applies it."""

    table: DataFrame
    most: int = 100_000
    _sets: dict[str, list[str]] | None = field(default=None, repr=False)

    def sets(self) -> dict[str, list[str]]:
        """The types by kind; a model of more than ``most`` entries is refused, as expressions hold them all."""
        if self._sets is None:
            rows = self.table.select("kind", "first", "second").limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"the model has more than {self.most} entries: raise its thresholds")
            self._sets = {k: sorted(r.first if k != "collocation" else f"{r.first} {r.second}" for r in rows if r.kind == k) for k in ("abbreviation", "starter", "collocation")}
        return self._sets

    def ends(self, t: Column, following: Column) -> Column:
        """Whether a sentence ends behind a token, given the one that follows."""
        sets = self.sets()
        among = lambda c, kind: c.isin(sets[kind]) if sets[kind] else F.lit(False)
        short = among(t["type"], "abbreviation") | t["type"].rlike(r"^\p{L}$")
        held = among(F.concat_ws(" ", t["type"], following["type"]), "collocation")
        period = F.when(held, False).when(short, following["upper"] & among(following["type"], "starter")).when(t["type"] == NUMBER, ~following["lower"]).otherwise(True)
        return F.when(t["mark"], True).when(t["dots"], following["upper"]).when(t["stop"], period).otherwise(False)

    def sentences(self, text: Column) -> Column:
        """The sentences of a text, in order, without blanks around them."""

        def cut(p: Column, starts: Column) -> Column:
            one = lambda s: F.transform(s, lambda at, i: T.strip(F.array_join(F.slice(p, at, F.coalesce(F.get(s, i + 1), F.size(p) + 1) - at), "")))
            return F.transform(F.array(starts), one)[0]

        return self._cut(text, cut)

    def count(self, text: Column) -> Column:
        """How many ``sentences`` a text has; they are not made."""
        return self._cut(text, lambda p, starts: F.size(starts))

    def _cut(self, text: Column, told: Callable[[Column, Column], Column]) -> Column:
        """What is told of a text's pieces, words with the blanks behind them, and of the places where sentences start, from 1.

        Only a piece with a mark can end one, so only these and those behind them are looked at as tokens.
        """
        pieces = F.regexp_extract_all(T.strip(F.coalesce(text, F.lit(""))), F.lit(r"\S+\s*"), F.lit(0))

        def of(p: Column) -> Column:
            marked = F.transform(p, lambda x, i: F.when((i + 1 < F.size(p)) & (x.contains(".") | x.contains("!") | x.contains("?")), i))
            both = F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("i"), token(F.get(p, i)).alias("t"), token(F.get(p, i + 1)).alias("f")))
            ends = F.transform(F.filter(both, lambda x: self.ends(x["t"], x["f"])), lambda x: x["i"] + 2)
            starts = F.concat(F.when(F.size(p) > 0, F.array(F.lit(1))).otherwise(F.expr("array()").cast("array<int>")), ends)
            return told(p, starts)

        return F.transform(F.array(pieces), of)[0]


#: What ``\S+`` of the engine finds; words whose token has no type; and distinct words that a task holds.
_RAW, _BARE, _HELD = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(f"{_OPEN[:-1]}*\\.*{_CLOSE[:-2]}*"), 500_000


class _Kinds(dict):
    """1 for a word with a mark, behind which a sentence may end; 2 for one whose token has no type; else 0."""

    def __missing__(self, word: str) -> int:
        self[word] = kind = 2 if _BARE.fullmatch(word) else int("." in word or "!" in word or "?" in word)
        return kind


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, following, n) over a task's texts: words as they stand, with null, and pairs behind a word with a mark."""
    words, pairs, kinds = Counter(), Counter(), _Kinds()

    def told() -> Iterator[pa.RecordBatch]:
        text = pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(words.keys(), text), pa.nulls(len(words), text), pa.array(words.values(), pa.int64())], names=["word", "following", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], text), pa.array([b for _, b in pairs], text), pa.array(pairs.values(), pa.int64())], names=["word", "following", "n"])

    for batch in batches:
        for value in batch.column(0):
            found = _RAW.findall(value.as_py() or "")
            kind = bytes(map(kinds.__getitem__, found))
            if 2 in kind:
                found, kind = [w for w, k in zip(found, kind, strict=True) if k != 2], kind.replace(b"\x02", b"")
            words.update(found)
            at = kind.find(1)
            while 0 <= at < len(found) - 1:
                pairs[found[at], found[at + 1]] += 1
                at = kind.find(1, at + 1)
            if len(words) + len(pairs) > _HELD:
                yield from told()
                words.clear()
                pairs.clear()
                kinds.clear()
    yield from told()


def fit(docs: DataFrame, text: str = "text", abbreviation: float = ABBREVIATION, collocation: float = COLLOCATION, starter: float = STARTER) -> SentenceModel:
    """The model of all texts, which are read once. Tokens are never gathered.

    Words as they stand, and pairs of them behind a mark, are counted in the tasks; only distinct ones are looked at as tokens.
    """
    spark = docs.sparkSession
    seen = docs.select(F.col(text).alias("text")).mapInArrow(_counted, "word string, following string, n long")
    seen = written(seen.groupBy("word", "following").agg(F.sum("n").alias("n")), "words")
    each = seen.where("following IS NULL").select(token(F.col("word")).alias("t"), "n").select("t.type", "t.stop", "n")
    summed = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    types = written(each.groupBy("type").agg(summed(F.col("stop"))("with_stop"), summed(~F.col("stop"))("without"), F.sum("n").alias("n")), "types")
    total, stops = types.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("with_stop"), F.lit(0))).first()
    schema = "kind string, first string, second string, score double"
    if not total or not stops or stops == total:
        return SentenceModel(spark.createDataFrame([], schema))

    letters = F.length(F.regexp_replace("type", r"\.", ""))
    share = stops / total
    null = F.col("with_stop") * math.log(share) + F.col("without") * math.log(1 - share)
    strong = F.col("with_stop") * math.log(0.99) + F.col("without") * math.log(0.01)
    score = -2.0 * (null - strong) * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    short = types.where((F.col("with_stop") > 0) & F.col("type").rlike(r"\p{L}")).withColumn("score", score).where(F.col("score") >= abbreviation)
    short = written(short.select("type", "score"), "abbreviations")

    nexts = seen.where("following IS NOT NULL").select(token(F.col("word")).alias("a"), token(F.col("following")).alias("b"), "n").where("a.stop OR a.mark")
    pairs = nexts.groupBy(F.col("a.type").alias("first"), F.col("b.type").alias("second"), F.col("a.stop").alias("stop")).agg(F.sum("n").alias("both"))
    pairs = pairs.join(short.select(F.col("type").alias("first"), F.lit(True).alias("short")), "first", "left")
    pairs = written(pairs.withColumn("short", F.coalesce("short", F.lit(False)) & F.col("stop")), "pairs")

    lettered = r"^[\p{L}\p{M}'’-]+$"
    after = pairs.where("NOT short").groupBy(F.col("second").alias("type")).agg(F.sum("both").alias("both"))
    sure = pairs.where("NOT short").agg(F.coalesce(F.sum("both"), F.lit(0))).first()[0]
    known = after.join(types.select("type", "n"), "type").where(F.col("type").rlike(lettered))
    starters = known.withColumn("score", association(F.col("both"), F.lit(float(sure)), F.col("n"), float(total))).where((F.col("score") >= starter) & (F.col("both") * total > F.col("n") * sure))
    starters = written(starters.select("type", "score"), "starters")

    held = pairs.where(F.col("stop") & (F.col("short") | (F.col("first") == NUMBER) | F.col("first").rlike(r"^\p{L}$")))
    held = held.where(F.col("second").rlike(lettered)).join(starters.select(F.col("type").alias("second")), "second", "left_anti")
    held = held.join(types.select(F.col("type").alias("first"), F.col("with_stop").alias("n1")), "first").join(types.select(F.col("type").alias("second"), F.col("n").alias("n2")), "second")
    held = held.withColumn("score", association(F.col("both"), F.col("n1"), F.col("n2"), float(total))).where((F.col("score") >= collocation) & (F.col("both") * total > F.col("n1") * F.col("n2")))

    none = F.lit(None).cast("string").alias("second")
    table = short.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("first"), none, "score")
    table = table.unionByName(starters.select(F.lit("starter").alias("kind"), F.col("type").alias("first"), none, "score"))
    table = table.unionByName(held.select(F.lit("collocation").alias("kind"), "first", "second", "score"))
    return SentenceModel(written(table, "sentence-model"))
