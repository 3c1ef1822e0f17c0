"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, limit: float = 60.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def positive(logit: Column, threshold: float = 0.5) -> Column:
    """Whether a logit's probability reaches the threshold; at one half, a logit of zero does."""
    return sigmoid(logit) >= threshold


def softmax(xs: Column) -> Column:
    """Probabilities of an array of logits."""

    def of(e: Column) -> Column:
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    shifted = F.transform(xs, lambda x: F.exp(x.cast("double") - F.array_max(xs)))
    return F.element_at(F.transform(F.array(shifted), of), 1)


def argmax(xs: Column) -> Column:
    """Place of the largest element, from 0; the first of equals."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def one_hot_logits(indexes: Column, size: int, high: float = 10.0) -> Column:
    """Logits that are ``high`` at the given places and ``-high`` at the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.array_contains(indexes, i), F.lit(high)).otherwise(F.lit(-high)))


def compacted(vector: Column, keep: list[int], fill: float | None = None) -> Column:
    """The elements at the listed places, nulls filled."""
    at = F.array(*[F.lit(i) for i in keep]) if keep else F.expr("array()").cast("array<int>")
    return F.transform(at, lambda i: F.coalesce(F.get(vector, i), F.lit(fill)) if fill is not None else F.get(vector, i))


def elementwise_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def number_or_zero(json_text: Column, path: str) -> Column:
    """A JSON number at a path; 0 for booleans, texts and absent values."""
    raw = F.get_json_object(json_text, path)
    return F.when(raw.rlike(r"^-?[0-9]"), F.coalesce(raw.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def _whole(x: Column, digits: int) -> Column:
    """|x| times 10^digits as a whole number: rounded by the exact binary value, ties to even.

    The product with the power is split into itself and its rounding error, so a value just beside a tie is not
    taken for one; rounding of the shortest decimal form, as the built-in functions do it, takes it for one.
    """
    power = float(10**digits)

    def of(x: Column) -> Column:
        wide = x * 134217729.0
        high = wide - (wide - x)
        p = x * power
        error = (high * power - p) + (x - high) * power
        low = F.floor(p)
        beyond = ((p - low) - 0.5) + error
        return low + F.when((beyond > 0) | ((beyond == 0) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)

    return F.transform(F.array(F.abs(x.cast("double"))), of).getItem(0)


def half_even(x: Column, digits: int = 4) -> Column:
    """x rounded to some digits (7 at most), by its exact binary value, ties to even; sizes from 10^11 on are left."""
    size = F.when(F.abs(x) < 1e11, _whole(x, digits) / F.lit(float(10**digits))).otherwise(F.abs(x))
    return F.when(x < 0, -size).otherwise(size)


def half_away(x: Column, digits: int) -> Column:
    """x rounded to some digits by its product with the power, halves away from zero, as engines round doubles.

    The built-in function takes the shortest decimal form: 261.8259705 is no half in binary, and its product is below one.
    Sizes whose product has no digits behind the point are left.
    """
    power = float(10**digits)
    of = lambda p: (F.floor(p) + F.when(p - F.floor(p) >= 0.5, 1).otherwise(0)) / F.lit(power)
    size = F.when(F.abs(x) * power < 2.0**52, F.transform(F.array(F.abs(x) * power), of).getItem(0)).otherwise(F.abs(x))
    return F.when(x < 0, -size).otherwise(size)


def fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """x with so many digits (1 to 7) behind the point, rounded as ``half_even``; null for null and for sizes from 10^11 on."""

    def written(n: Column) -> Column:
        text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), F.lit("0"))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."), F.right(text, F.lit(digits)))

    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
    return F.when(F.abs(x) < 1e11, F.concat(sign, F.transform(F.array(_whole(x, digits)), written).getItem(0)))


def seconds_text(ms: Column) -> Column:
    return fixed(ms / 1000, 1)


def flag_text(b: Column) -> Column:
    return F.when(b.isNull(), "").when(b, "true").otherwise("false")


def elapsed_ms(ts: Column, start: Column) -> Column:
    return F.unix_millis(ts) - F.unix_millis(start)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def topic_probabilities(logits: Column, topics: list[str], digits: int = 4) -> Column:
    """Map of topic to probability, from an array of logits in topic order."""
    return F.map_from_arrays(F.array(*map(F.lit, topics)), F.transform(F.slice(logits, 1, len(topics)), lambda x: half_even(sigmoid(x.cast("double")), digits)))


def predicted_topics(logits: Column, topics: list[str], threshold: float = 0.5) -> Column:
    """Topics whose probability reaches the threshold, most likely first; equal ones in topic order."""
    rows = F.transform(F.slice(logits, 1, len(topics)), lambda x, i: F.struct((-sigmoid(x.cast("double"))).alias("p"), i.alias("i")))
    chosen = F.filter(rows, lambda r: r["p"] <= -threshold)
    return F.transform(F.array_sort(chosen), lambda r: F.get(F.array(*map(F.lit, topics)), r["i"]))


def pooled(vectors: Column, mask: Column, last: bool = False) -> Column:
    """The vector of the first (or last) real token of a padded sequence: the place where the mask is above 0; null without one."""
    real = F.filter(F.transform(vectors, lambda v, i: F.when(F.coalesce(F.get(mask, i), F.lit(0)) > 0, F.struct(i.alias("at"), v.alias("v")))), lambda x: x.isNotNull())
    return F.when(F.size(real) > 0, F.element_at(real, -1 if last else 1)["v"])
