"""Text functions as column expressions.

Blank characters follow the Unicode definition, so patterns carry the ``(?U)`` flag and
``strip`` removes every kind of blank, not just the space that SQL ``trim`` removes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausemill.functions.numeric import fixed


#: The characters of ``(?U)\\s``.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; outer blanks go; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def line_ends(c: Column) -> Column:
    """CRLF becomes LF, outer blanks go."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which the engine has no function for; null passes through."""
    return s.str.normalize("NFKC")


def clause_text(c: Column, compose: bool = True) -> Column:
    """Canonical clause text: composed, blanks collapsed, stripped; null becomes the empty text."""
    return collapse(nfkc(c) if compose else c)


@F.pandas_udf(StringType())
def entities(s: pd.Series) -> pd.Series:
    """Character references decoded, by the full table of the standard library."""
    import html

    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def closed_entities(s: pd.Series) -> pd.Series:
    """``entities``, but only of references that end in a semicolon: what a cut text left of one stays as it is."""
    import html
    import html.entities
    import re

    whole = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return s.map(lambda t: whole.sub(one, t), na_action="ignore")


def html_clean(c: Column, decode: bool = True, closed: bool = False) -> Column:
    """Entities decoded (only ``closed`` ones, if asked), tags become spaces, blanks collapsed."""
    found = (closed_entities(c) if closed else entities(c)) if decode else c
    return collapse(F.regexp_replace(found, r"<[^>]+>", " "))


def matching_text(c: Column) -> Column:
    """Lower case with blanks collapsed, for containment tests."""
    return F.lower(collapse(c))


def word_set(c: Column) -> Column:
    """Distinct lower-case words with punctuation deleted."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.array_distinct(F.array_remove(F.split(strip(bare), r"(?U)\s+"), ""))


def change_text(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and blanks becomes a space; blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))  # one pass: blanks are among what becomes a space


def change_words(c: Column) -> Column:
    """Distinct words of more than two characters of a change text."""
    return F.array_distinct(F.filter(F.split(change_text(c), " "), lambda w: F.length(w) > 2))


def label_key(c: Column) -> Column:
    """Label normaliser: runs of blanks or underscores become one space, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)[\s_]+", " ")))


def screen_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard of two arrays without repeats; ``both_empty`` is its value where neither has an element."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(shared / F.greatest(total, F.lit(1)))


def segments(c: Column, separators: str = "[;,]") -> Column:
    """Trimmed, non-empty parts of a list in a text; null gives none."""
    return F.array_remove(F.transform(F.split(F.coalesce(c, F.lit("")), separators), strip), "")


def tri_state(c: Column) -> Column:
    """true / 1 / yes and false / 0 / no as booleans, anything else null."""
    x = F.lower(strip(c.cast("string")))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("false", "0", "no"), False)


_CODE_SCORE = r"^([A-Za-z_]+)\s+(-?1|0)\s*$"


def code_of(segment: Column, alias: dict[str, str] | None = None) -> Column:
    """The code of a ``code score`` segment, through an alias table; null where it does not parse."""
    found = F.nullif(F.regexp_extract(segment, _CODE_SCORE, 1), F.lit(""))
    return aliased(found, alias or {})


def score_of(segment: Column) -> Column:
    """The score -1, 0 or 1 of a ``code score`` segment; null where it does not parse."""
    return F.nullif(F.regexp_extract(segment, _CODE_SCORE, 2), F.lit("")).try_cast("int")


def aliased(c: Column, alias: dict[str, str]) -> Column:
    found = F.trim(c)
    for name, code in alias.items():
        found = F.when(F.trim(c) == name, F.lit(code)).otherwise(found)
    return found


def segment_status(segment: Column, codes: Sequence[str], alias: dict[str, str] | None = None) -> Column:
    """Why a segment does not parse: empty, document_note, unclear, unknown_code, missing_score; else parsed."""
    s = F.lower(strip(F.coalesce(segment, F.lit(""))))
    first = aliased(F.regexp_extract(strip(segment), r"^([A-Za-z_]+)", 1), alias or {})
    return (
        F.when(s == "", "empty")
        .when(s.startswith("docu"), "document_note")
        .when(s.startswith("uncle"), "unclear")
        .when(~F.lower(first).isin([c.lower() for c in codes]), "unknown_code")
        .when(score_of(strip(segment)).isNull(), "missing_score")
        .otherwise("parsed")
    )


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """Topic letters and level 1 to 3 of a tag; nulls where it is malformed."""
    pattern = r"^([a-z]+)([123])$"
    return F.nullif(F.regexp_extract(tag, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(tag, pattern, 2), F.lit("")).try_cast("int")


def level_score(level: Column) -> Column:
    """Fairness level 1, 2, 3 as score 1, 0, -1."""
    return F.lit(2) - level


def score_class(score: Column) -> Column:
    """Score -1, 0, 1 as class 0, 1, 2."""
    return score + 1


def ordinal(c: Column, table: dict[str, int]) -> Column:
    """A label's score by a table, null where it is not in it."""
    found = F.lit(None).cast("int")
    for name, score in table.items():
        found = F.when(F.lower(F.trim(c)) == name, F.lit(score)).otherwise(found)
    return found


def first_code(c: Column, codes: Sequence[str]) -> Column:
    """The first standalone code, longest alternatives first, in lower case; null where there is none."""
    choice = "|".join(sorted(codes, key=len, reverse=True))
    return F.nullif(F.lower(F.regexp_extract(c, rf"(?i)\b({choice})\b", 1)), F.lit(""))


def contains_text(needle: Column, haystack: Column, least_words: int = 6) -> Column:
    """Whether the haystack holds the needle, or any run of ``least_words`` of its words, blanks and case aside."""
    n, h = matching_text(needle), matching_text(haystack)

    def run(words: Column) -> Column:
        starts = F.when(F.size(words) >= least_words, F.sequence(F.lit(1), F.size(words) - (least_words - 1))).otherwise(F.expr("array()").cast("array<int>"))
        return F.exists(starts, lambda i: F.contains(h, F.array_join(F.slice(words, i, least_words), " ")))

    return F.contains(h, n) | F.element_at(F.transform(F.array(F.split(n, " ")), run), 1)


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent last e; one at least; none for an empty word."""
    w = F.regexp_replace(F.lower(word), r"""^[.,;:!?"'()\[\]]+|[.,;:!?"'()\[\]]+$""", "")
    groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    silent = w.endswith("e") & (groups > 1) & ~w.endswith("le") & ~w.endswith("ee")
    return F.when(w == "", 0).otherwise(F.greatest(groups - silent.cast("int"), F.lit(1)))


def readability_counts(c: Column) -> tuple[Column, Column, Column]:
    """Sentences, words and syllables of a text."""
    text = F.coalesce(c, F.lit(""))
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: strip(s) != ""))
    found = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))
    return sentences, F.size(found), F.aggregate(F.transform(found, syllables), F.lit(0), lambda a, b: a + b)


def flesch(sentences: Column, words: Column, syllable_count: Column) -> tuple[Column, Column]:
    """Reading ease and grade level; null without words or sentences."""
    some = (words > 0) & (sentences > 0)
    per_sentence, per_word = words / sentences, syllable_count / words
    ease = F.when(some, 206.835 - 1.015 * per_sentence - 84.6 * per_word)
    return ease, F.when(some, 0.39 * per_sentence + 11.8 * per_word - 15.59)


def preview(c: Column, size: int = 100) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, whole."""
    return F.floor(F.length(c) / 4).cast("long")


def truncated(c: Column, tokens: int, notice: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > 4 * tokens, F.concat(F.substring(c, 1, 4 * tokens), F.lit(notice))).otherwise(c)


def category_of(c: Column, separator: str = "__") -> Column:
    """What follows the last separator, ``unknown`` without one."""
    return F.when(F.contains(c, F.lit(separator)), F.substring_index(c, separator, -1)).otherwise("unknown")


def unfenced(c: Column) -> Column:
    """A text without the code fence around it."""
    return strip(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))


def recovered_score(c: Column) -> Column:
    """The first standalone -1, 0 or 1 of the first line; null without one."""
    line = F.substring_index(strip(c), "\n", 1)
    return F.nullif(F.regexp_extract(line, r"(?<![0-9.-])(-1|0|1)(?![0-9.])", 1), F.lit("")).try_cast("int")


def cache_key(tag: str, c: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(tag), c)), 1, 16)


def run_id(*parts: Column) -> Column:
    """Parts joined by a double underscore; null parts are left out."""
    return F.concat_ws("__", *parts)


def interval_cell(point: Column, low: Column, high: Column) -> Column:
    return F.concat(fixed(point, 3), F.lit(" ["), fixed(low, 3), F.lit(", "), fixed(high, 3), F.lit("]"))


def spread_cell(mean: Column, sd: Column) -> Column:
    return F.concat(fixed(mean, 3), F.lit(" ± "), fixed(sd, 3))


def delta_cell(x: Column) -> Column:
    return fixed(x, 3, plus=True)


def expanded_query(c: Column, synonyms: dict[str, str]) -> Column:
    """The query with the synonyms of the first key, in order of the table, that it holds."""
    found = c
    for key, words in reversed(list(synonyms.items())):
        found = F.when(F.contains(F.lower(c), F.lit(key.lower())), F.concat_ws(" ", c, F.lit(words))).otherwise(found)
    return found


def json_cell(c: Column, schema: str) -> Column:
    """A JSON text as a value of a schema; null for null and for what does not parse."""
    return F.from_json(F.nullif(F.trim(c), F.lit("")), schema)


def without_ids(ids: Column, excluded: Sequence[str]) -> Column:
    """A list of ids without the excluded ones, in its order."""
    return F.filter(ids, lambda x: ~x.isin(list(excluded)))


#: Community classes and their scores; a blocker is a bad clause of its own kind.
CLASS_SCORES = {"blocker": -1, "bad": -1, "neutral": 0, "good": 1}


def class_score(c: Column) -> tuple[Column, Column, Column]:
    """Score of a community class, whether it is a blocker, and its parse status; other classes have no score."""
    score = ordinal(c, CLASS_SCORES)
    return score, F.coalesce(F.lower(F.trim(c)) == "blocker", F.lit(False)), F.when(score.isNull(), "unknown_class").otherwise("parsed")


def domain_int(c: Column, low: int = -1, high: int = 1) -> Column:
    """A text as a whole number of a domain; null for anything else."""
    x = c.try_cast("double")
    return F.when((x == F.floor(x)) & x.between(low, high), x.try_cast("int"))


def first_text(*cs: Column) -> Column:
    """The first of the texts that is not blank; null if all are."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


def holds_any_code(segment: Column, codes: Sequence[str]) -> Column:
    """Whether a lower-cased segment holds any of the codes as a substring. It finds codes inside words, and never one with capitals."""
    s = F.lower(segment)
    found = F.lit(False)
    for code in codes:
        found = found | F.contains(s, F.lit(code))
    return found


def company_of(filename: Column, *others: Column) -> Column:
    """The company from a document's file name, else from other columns."""
    return first_text(F.regexp_replace(filename, r"(?i)\.docx$", ""), *others)


def changed_pair(old: Column, new: Column, explanation: Column) -> Column:
    """(source, explanation) of a change, the new text before the old one; null where either is blank."""
    source, told = first_text(new, old), first_text(explanation)
    return F.when(source.isNotNull() & told.isNotNull(), F.struct(source.alias("source"), told.alias("explanation")))
