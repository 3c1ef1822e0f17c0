"""Personal data by weak supervision: base rules, wider candidates, labelers, a label model and a span classifier.

1. Base rules find the sure spans of each kind; these always stay.
2. Wider patterns find candidates, among them most base spans. Five labelers vote on each candidate (+1, 0,
   -1): strict form, validity (checksum, ranges), gazetteer (top-level domains, issuer prefixes, calling codes),
   context words before the span, and its boundaries.
3. Expectation-maximisation over the counts of vote patterns estimates, for each kind, how often spans are
   real and how each labeler votes on real and on other spans.
4. A logistic classifier for each kind is fitted to the posteriors, from the counts of feature patterns. It
   decides which candidates are added, in a linear column expression; spans that overlap a base span are not.

Extraction, votes, counts and decisions are column expressions over whole texts. The tables that reach the
driver hold one row for each pattern: at most 4 kinds x 3^5 votes x 2^4 features, whatever the input.

Defined results for odd input: a null text counts as empty and has no span; texts are read whole; bytes that are not UTF-8 become
U+FFFD, which counts in offsets; equal rows
give equal results, row by row; an empty table gives an empty table and a model that keeps its priors; other
columns pass through untouched, whatever their names, but for those named as an added one in any case of letters,
which it replaces. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import Passing, let, levels, running, utf8
from clausemill.llm.store import Store

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Possessive quantifiers and the look-behind leave the matches as they are and make long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern of the kind, or a wide one, to match.
NEEDS = {"email": r"@|[(\[{] ?(?i:at) ?[)\]}]", "ip": r"[0-9](?:\.|\[\.\])[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9][ .-]?[0-9]", "phone": r"[0-9][ ().-]{0,2}[0-9]|\+[0-9][ ().0-9-]+[0-9]"}
#: Candidate patterns.
WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++ ?(?:@|[(\[{] ?(?i:at) ?[)\]}]) ?[\p{L}0-9-]++(?:(?:\.| ?[(\[{] ?(?i:dot) ?[)\]}] ?)[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,4}(?:(?:\.|\[\.\])[0-9]{1,4}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ().-]{0,2}[0-9]){8,14}(?![0-9A-Za-z])",
}

#: Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov mil int info biz name io ai app dev me co uk de fr es it nl be ch at se no dk fi pl pt cz ru ua jp cn kr in au nz ca us br mx ar cl za eu".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|30[0-5]|3[68]|6011|64[4-9]|65|62)"
CALLING_CODES = r"^\+?(?:00)?(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": r"(?:e-?mail|mail|contact|write|correo|courriel|kontakt)",
    "ip": r"(?:\bip\b|address|server|host|login|logged|client|adresse|direcci)",
    "card": r"(?:card|credit|debit|visa|master|amex|payment|karte|carte|tarjeta)",
    "phone": r"(?:phone|tel\b|tel[.:]|mobile|cell|call|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono)",
}
AGAINST = r"(?:token|secret|key|hash|sha|md5|uuid|guid|isbn|issn|doi|version|build|release|invoice|order|serial|section|\bid\b|v\.?$|[=\"'#/_-]\s*$)"

#: Prior reliabilities: how each labeler votes on other (first) and on real spans. A failed checksum or range
#: is all but proof; the other labelers are known to err. They count as ``PRIOR_WEIGHT`` times the sample.
PRIOR_WEIGHT = 0.5
_WEAK = ({1: 0.25, 0: 0.35, -1: 0.4}, {1: 0.6, 0: 0.3, -1: 0.1})
PRIORS = {"strict": _WEAK, "valid": ({1: 0.2, 0: 0.1, -1: 0.7}, {1: 0.98, 0: 0.019, -1: 0.001}), "listed": _WEAK, "context": _WEAK, "bounded": _WEAK}

VOTES = ("strict", "valid", "listed", "context", "bounded")
SHAPE = ("grouped", "plain", "long", "quoted")


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and without overlap: array of (start, end, match, before, after).

    The starts are running sums of the lengths between, so a text with many matches costs n log n.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(g: Column, f: Column) -> Column:
        steps = F.transform(f, lambda m, i: (F.length(F.get(g, i)) + F.coalesce(F.length(F.get(f, i - 1)), F.lit(0))).cast("long"))

        def span(starts: Column) -> Column:
            return F.transform(
                f,
                lambda m, i: F.struct(
                    F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("match"), F.right(F.get(g, i), F.lit(40)).alias("before"), F.left(F.get(g, i + 1), F.lit(2)).alias("after")
                ),
            )

        return let(running(steps, lambda v, w: v + w), span)

    return let(found, lambda f: let(gaps, lambda g: place(g, f)))


def reach_of(spans: Column) -> Column:
    """Spans by start, each with the farthest end up to it: array of (start, far), which ``touched`` searches."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("far"))))
    return running(ordered, lambda v, w: F.struct(v["start"].alias("start"), F.greatest(v["far"], w["far"]).alias("far")))


def touched(reach: Column, span: Column) -> Column:
    """Whether a span overlaps one of those: a binary search for the last that starts before its end."""
    steps = F.transform(F.reverse(F.concat(F.array(F.lit(0)), levels(F.size(reach)))), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    last = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(reach, low + s - 1)["start"] < span["end"], low + s).otherwise(low))
    return F.coalesce(let(last, lambda i: F.get(reach, i - 1)["far"] > span["start"]), F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def valid(kind: str, match: Column) -> Column:
    """The condition of the base rule on a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    none = F.expr("array()").cast("array<struct<start:long,end:long,match:string,before:string,after:string>>")
    return F.when(text.rlike(NEEDS[kind]), F.filter(located(text, BASE[kind]), lambda s: valid(kind, s["match"]))).otherwise(none)


def _vote(yes: Column, no: Column | None = None) -> Column:
    found = F.when(yes, 1)
    return (found if no is None else found.when(no, -1)).otherwise(0)


def _judged(kind: str, s: Column) -> Column:
    """One candidate with its votes and shape, as a struct."""
    m, before, after = s["match"], F.lower(s["before"]), s["after"]
    digits = _digits(m)
    n = F.length(digits)
    bounded = ~before.rlike(r"[\p{L}0-9_]$") & ~after.rlike(r"^[\p{L}0-9_]")
    strict = {
        "email": m.rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z"),
        "ip": m.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"),
        "card": m.rlike(r"\A[0-9]{13,19}\z|\A[0-9]{4}(?:[ -][0-9]{4}){3}\z"),
        "phone": m.rlike(r"\A\(?[0-9]{2,4}\)?[ .-][0-9 .-]+\z"),
    }[kind]
    checked = {
        "email": m.rlike(r"[\p{L}0-9].*(?:@|at).*\p{L}{2,}\z"),
        "ip": valid("ip", F.regexp_replace(m, r"\[\.\]", ".")) | m.rlike(r"::|[0-9A-Fa-f]{3,4}:"),
        "card": luhn(digits),
        "phone": n.between(9, 15) & ~(n.between(13, 19) & luhn(digits)),
    }[kind]
    listed = {
        "email": F.lower(F.regexp_extract(m, r"(\p{L}+)\z", 1)).isin(TOP_DOMAINS),
        "ip": ~m.rlike(r"\A(?:0|[1-9])(?:\.[0-9]){3}\z"),
        "card": digits.rlike(CARD_PREFIX),
        "phone": digits.rlike(r"^(?:0[1-9]|[2-9][0-9]{2}[2-9])") | F.concat(F.lit("+"), digits).rlike(CALLING_CODES) & m.rlike(r"[ ().-]"),
    }[kind]
    grouped = m.rlike(r"[ ().\[\]-]")
    return F.struct(
        F.lit(kind).alias("kind"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        _vote(strict).alias("strict"),
        _vote(checked, ~checked).alias("valid"),
        _vote(listed, ~listed).alias("listed"),
        _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)).alias("context"),
        _vote(bounded, ~bounded).alias("bounded"),
        grouped.cast("int").alias("grouped"),
        m.rlike(r"\A[0-9]+\z").cast("int").alias("plain"),
        (F.length(m) > 24).cast("int").alias("long"),
        (before.rlike(r"[\"'=]\s*$") | after.rlike(r"^[\"']")).cast("int").alias("quoted"),
    )


_CANDIDATE = f"struct<kind:string,start:long,end:long,{','.join(f'{n}:int' for n in VOTES + SHAPE)}>"


def candidates(text: Column, kind: str) -> Column:
    none = F.expr("array()").cast(f"array<{_CANDIDATE}>")
    return F.when(text.rlike(NEEDS[kind]), F.transform(located(text, WIDE[kind]), lambda s: _judged(kind, s))).otherwise(none)


def label_model(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[dict[int, float]]]]:
    """EM for one kind over (votes, count): the share of real spans and, for each labeler, P(vote | other or real)."""
    share = 0.5
    rate = [[dict(PRIORS[name][y]) for y in (0, 1)] for name in VOTES]
    weight = 2.0 + PRIOR_WEIGHT * sum(n for _, n in counts)
    for _ in range(rounds if counts else 0):
        real = 1.0
        seen = [[{v: weight * PRIORS[name][y][v] for v in (1, 0, -1)} for y in (0, 1)] for name in VOTES]
        total = 2.0
        for votes, n in counts:
            p = posterior(votes, share, rate)
            real += n * p
            total += n
            for j, v in enumerate(votes):
                seen[j][1][v] += n * p
                seen[j][0][v] += n * (1 - p)
        share = real / total
        rate = [[{v: x / sum(c.values()) for v, x in c.items()} for c in pair] for pair in seen]
    return share, rate


def posterior(votes: tuple[int, ...], share: float, rate: list[list[dict[int, float]]]) -> float:
    odds = math.log(share) - math.log1p(-share)
    for j, v in enumerate(votes):
        odds += math.log(rate[j][1][v]) - math.log(rate[j][0][v])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def features(votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *map(float, shape)]


def span_classifier(rows: list[tuple[list[float], float, int]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression on (features, soft label, count) by gradient descent from zero."""
    size = 1 + 2 * len(VOTES) + len(SHAPE)
    w, total = [0.0] * size, sum(n for _, _, n in rows)
    for _ in range(rounds if total else 0):
        slope = [decay * x for x in w]
        for x, y, n in rows:
            z = sum(a * b for a, b in zip(w, x, strict=True))
            e = n / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - y)
            for j, b in enumerate(x):
                slope[j] += e * b
        w = [a - 4 * rate * b for a, b in zip(w, slope, strict=True)]
    return w


def fit(patterns: list[tuple]) -> dict[str, list[float]]:
    """Weights for each kind, from (kind, votes..., shape..., count) rows."""
    weights = {}
    for kind in KINDS:
        own = sorted((tuple(r[1 : 1 + len(VOTES)]), tuple(r[1 + len(VOTES) : -1]), r[-1]) for r in patterns if r[0] == kind)
        by_votes: dict[tuple, int] = {}
        for votes, _, n in own:
            by_votes[votes] = by_votes.get(votes, 0) + n
        share, rate = label_model(sorted(by_votes.items()))
        weights[kind] = span_classifier([(features(v, s), posterior(v, share, rate), n) for v, s, n in own])
    return weights


def _score(c: Column, weights: dict[str, list[float]]) -> Column:
    votes, shape = [c[v] for v in VOTES], [c[s] for s in SHAPE]
    found = F.lit(-1.0)
    for kind, w in weights.items():
        terms = [(v > 0).cast("int") * a + (v < 0).cast("int") * b for v, a, b in zip(votes, w[1:], w[1 + len(VOTES) :], strict=False)]
        terms += [s * a for s, a in zip(shape, w[1 + 2 * len(VOTES) :], strict=True)]
        total = F.lit(w[0])
        for t in terms:
            total = total + t
        found = F.when(c["kind"] == kind, total).otherwise(found)
    return found


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with ``base`` and ``added``: arrays of (kind, start, end), by kind as listed, then start."""
    store = Store(docs.sparkSession, "pii")
    passing = Passing(docs, ["base", "added"], without=[text])
    whole = passing.inner.select(*passing.kept, F.coalesce(utf8(F.col(passing.inside(text))), F.lit("")).alias("whole"))
    only = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.concat(*[F.transform(base_spans(F.col("whole"), k), only(k)) for k in KINDS])
    wide = F.concat(*[candidates(F.col("whole"), k) for k in KINDS])
    found = store.save(whole.select(*passing.kept, base.alias("base"), wide.alias("candidates")), "candidates")

    patterns = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in VOTES + SHAPE]).count().collect()
    weights = fit([tuple(r) for r in patterns])

    real = F.filter("candidates", lambda c: _score(c, weights) > 0)
    free = lambda own, others: F.when((F.size(own) == 0) | (F.size(others) == 0), own).otherwise(let(reach_of(others), lambda r: F.filter(own, lambda c: ~touched(r, c))))

    def apart(c: Column) -> Column:  # candidates of two kinds may meet: the first kind listed stays
        of = lambda kinds: F.filter(c, lambda x: x["kind"].isin(*kinds))
        return F.when(F.size(c) < 2, c).otherwise(F.concat(of(KINDS[:1]), *[let(of(KINDS[:k]), lambda before: free(of([KINDS[k]]), before)) for k in range(1, len(KINDS))]))  # noqa: B023

    added = let(real, lambda r: let(free(r, F.col("base")), apart))
    done = found.select(*passing.kept, "base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))
    return passing.outer(done, "base", "added")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    ranked = F.sort_array(F.transform(spans, lambda s: F.struct(_rank(s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
