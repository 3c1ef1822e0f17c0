"""Quality rules, line first: judge lines, drop the failures, then judge what is left of the document.

Everything is a column expression over one row, so there is no shuffle and no Python on the executors.

Defined results for odd input: a null text counts as the empty text, which has no words and fails the
base rule; bytes that are not UTF-8 become U+FFFD in what is judged; a text of any length is read whole; equal rows give equal results, row by row; an empty table
gives an empty table; other columns pass through untouched, whatever their names, but for those named as an
added one in any case of letters, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import BLANKS, Passing, let, occurrences, utf8, words

#: Phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here to",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the base rule and of the line rules."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: A line fails when more of its characters are symbols,
    max_symbol_share: float = 0.10
    #: when more of its letters are capitals (in lines of some length),
    max_capital_share: float = 0.6
    min_letters: int = 20
    #: when more of its words end in exclamation marks,
    max_exclaimed_share: float = 0.3
    #: when separators of menus stand at least this often per word,
    max_separator_share: float = 0.25
    min_separators: int = 2
    #: when fewer of its words are distinct (in lines of some length),
    min_distinct_share: float = 0.25
    min_line_words: int = 12
    #: or when it is a fragment: few words, no closing punctuation.
    max_fragment_words: int = 3
    #: A document fails when lines with fewer of its word characters pass.
    min_kept_share: float = 0.5


def _covered(hashes: Column, size: int) -> Column:
    """Words in windows whose hash occurs twice, from the hashes of all windows in order.

    The hashes are sorted with their places; equal neighbours mark repeated windows, and each
    repeated window adds the words up to the next one, ``size`` at most.
    """

    def places(s: Column) -> Column:
        same = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["p"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(placed, lambda s: let(places(s), total))


def repeated_window_words(word_hashes: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the same text."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.expr("array()").cast("array<int>"))
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, size)),
        )

    return let(word_hashes, of).cast("long")


def line_passes(line: Column, found: Column, rules: Rules) -> Column:
    """Whether one line with its words passes all line rules; a line without words passes."""
    chars, n = F.length(line), F.size(found)
    symbols = occurrences(line, r"[#*$%&|<>]")
    separators = occurrences(line, r"[|»›>·•]")
    exclaimed = occurrences(line, r"!") / F.lit(2.0)

    def shouted(capitals: Column) -> Column:
        of = lambda small: (capitals + small >= rules.min_letters) & (capitals > rules.max_capital_share * (capitals + small))
        # the first test follows from the others and spares most lines the second count
        return (capitals > rules.max_capital_share * rules.min_letters) & let(occurrences(line, r"[\p{Ll}]"), of)

    def furniture(low: Column) -> Column:
        has = F.lit(False)
        for phrase in BOILERPLATE:
            has = has | F.contains(low, F.lit(phrase))
        return has

    fails = (
        (symbols > rules.max_symbol_share * chars)
        | let(occurrences(line, r"[\p{Lu}]"), shouted)
        | ((n >= 3) & (exclaimed > rules.max_exclaimed_share * n))
        | let(separators, lambda s: (s >= rules.min_separators) & (s > rules.max_separator_share * n))
        | ((n >= rules.min_line_words) & (F.size(F.array_distinct(found)) < rules.min_distinct_share * n))
        | ((n <= rules.max_fragment_words) & ~line.rlike(r"""[.!?…:;。！？"'”’»)\]]\s*$"""))
        | ((n <= 40) & let(F.lower(line), furniture))
    )
    return (n == 0) | ~fails


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "kept_share", "kept")


def line_first_quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Adds the counts, ``clean_text`` (the lines that pass), ``kept_share``, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rule fails, where no word is left, or where the passing lines hold
    less than ``min_kept_share`` of the word characters.
    """
    passing = Passing(docs, ADDED)
    lined = passing.inner.select(*passing.kept, F.coalesce(utf8(F.col(passing.inside(text))), F.lit("")).alias("whole")).withColumn(
        "lines", F.transform(F.split("whole", "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("words")))
    )
    # a line's end is a blank, so the words of the text are those of its lines
    counted = lined.withColumn("words", F.flatten(F.transform("lines", lambda x: x["words"])))
    measured = counted.select(
        *passing.kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        occurrences(F.col("whole"), r"[#*$%&|<>]").alias("n_symbols"),
        let(
            F.transform(F.filter("lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"]),
            lambda x: F.size(x) - F.size(F.array_distinct(x)),
        )
        .cast("long")
        .alias("n_dup_lines"),
        repeated_window_words(F.transform("words", lambda w: F.xxhash64(w)), rules.window).alias("n_repeat_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: line_passes(x["line"], x["words"], rules)), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    judged = measured.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    ).withColumn(
        "kept_share",
        F.when(F.col("word_chars") > 0, F.length(F.regexp_replace("clean_text", BLANKS + "+", "")) / F.col("word_chars")).otherwise(0.0),
    )
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= rules.min_kept_share))
    return passing.outer(judged, *ADDED)
