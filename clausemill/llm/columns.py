"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks that separate words: space and U+0009 to U+000D.
BLANKS = r"[ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once per row however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def utf8(text: Column) -> Column:
    """The text with bytes that are not UTF-8 as U+FFFD: the one rule of all operators, at their entry."""
    return F.make_valid_utf8(text.cast("string"))


def words(text: Column) -> Column:
    """The maximal runs of other characters than blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


def occurrences(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` are in ``char_class``, as long."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))).cast("long")


def levels(n: Column) -> Column:
    """1 to the number of doublings that reach n; none for 0 and 1."""
    most = F.ceil(F.log2(n.cast("double"))).cast("int")
    return F.when(n > 1, F.sequence(F.lit(1), most)).otherwise(F.expr("array()").cast("array<int>"))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it (by an associative function), in as many passes as doublings reach the size."""

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k - 1).cast("int")
        return F.transform(acc, lambda v, i: let(F.get(acc, i - back), lambda w: F.when(w.isNull(), v).otherwise(join(v, w))))

    return let(values, lambda x: F.aggregate(levels(F.size(x)), x, step))


def place_of(columns: list[str], name: str) -> int:
    """Where a column is: the first of that very name, else the first that differs by case only."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(columns):
            if same(c):
                return i
    raise ValueError(f"no column {name} among {', '.join(columns)}")


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Columns of the caller under names of ours, whatever else the table holds, also names that differ by case only."""
    places = {own: place_of(df.columns, name) for own, name in names.items()}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(own) for own, i in places.items()])


class Passing:
    """The columns of a caller on their way through an operator.

    Inside they are called c0, c1 and so on, so no name of theirs meets one of the operator's own. At the end they
    get their names back. A column whose name equals an added one, in any case of letters, gives way to it.
    """

    def __init__(self, df: DataFrame, added: Iterable[str], without: Iterable[str] = ()):
        self.names = df.columns
        self.inner = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        gone = {a.lower() for a in added}
        left = {place_of(self.names, w) for w in without}
        self._kept = [i for i, c in enumerate(self.names) if c.lower() not in gone and i not in left]
        self.kept = [f"c{i}" for i in self._kept]

    def inside(self, name: str) -> str:
        """What a column of the caller is called inside."""
        return f"c{place_of(self.names, name)}"

    def outer(self, df: DataFrame, *added: str) -> DataFrame:
        """The caller's columns under their names, then the added ones."""
        return df.select(*self.kept, *added).toDF(*[self.names[i] for i in self._kept], *added)
