"""Joins, reshaping, windows and set operations that the other modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffixed(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    """All columns but the kept ones with a suffix, so that a join has no clashing names."""
    return df.toDF(*[c if c in keep else f"{c}{suffix}" for c in df.columns])


def merge(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on keys; columns of both sides with one name get suffixes."""
    clash = (set(a.columns) & set(b.columns)) - set(on)
    rename = lambda df, s: df.withColumnsRenamed({c: f"{c}{s}" for c in clash})
    return rename(a, suffixes[0]).join(rename(b, suffixes[1]), on, how)


def lookup(df: DataFrame, dim: DataFrame, on: list[str], required: bool = False) -> DataFrame:
    """Left join to a dimension whose keys are unique; where ``required``, a key that it lacks raises.

    The engine broadcasts the dimension when it knows it to be small.
    """
    told = df.join(dim.withColumn("__found", F.lit(True)), on, "left")
    if required:
        raised = F.raise_error(F.concat(F.lit("no entry for "), F.concat_ws("/", *[F.col(c).cast("string") for c in on])))
        told = told.withColumn("__found", F.when(F.col("__found").isNull(), raised.cast("boolean")).otherwise(F.col("__found"))).where(F.col("__found").isNotNull())
    return told.drop("__found")


def identity_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side: must give no row for paired runs."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("only_in", F.lit(side))
    return one(a, b, "a").unionByName(one(b, a, "b"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column value with the margins ``All``, from one grouped set; wide over the given values."""
    cube = df.groupingSets([[row, column], [row], [column], []], row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("__r"), F.grouping(column).alias("__c"))
    named = cube.select(F.when(F.col("__r") == 1, "All").otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("__c") == 1, "All").otherwise(F.col(column).cast("string")).alias("__v"), "n")
    return named.groupBy(row).pivot("__v", [*map(str, values), "All"]).agg(F.sum("n")).na.fill(0)


def pivot(df: DataFrame, row: str, column: str, values: list, agg: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(agg).na.fill(0)


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and shares of values, most frequent first."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("__total"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total").orderBy(F.desc("n"), *columns)


#: Values looked at for each range that rows are dealt into, and ranges for each shuffle partition.
_LOOKED_AT, _RANGES = 16, 2


def range_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """One row with ``__bounds``, a sorted array of structs of ``by`` that cuts the rows into ranges.

    One pass takes the value with the largest second hash out of each of a fixed number of hash classes, which is a
    sample of the distinct values whatever order they come in; the classes, not the rows, bound what reaches the driver. The bounds come back as literals, so every
    plan that uses them deals the rows alike, whatever it prunes and however often a task is run.
    """
    spark = df.sparkSession
    ranges = _RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by)
    seen = df.groupBy(F.pmod(F.xxhash64(*by), F.lit(ranges * _LOOKED_AT)).alias("__class")).agg(F.max_by(key, F.xxhash64(*by, F.lit(1))).alias("k"))
    found = [r.k for r in seen.select("k").orderBy("k").collect()]
    step = max(1, len(found) // ranges)
    return spark.createDataFrame([(found[step::step],)], T.StructType([T.StructField("__bounds", T.ArrayType(df.select(key.alias("k")).schema["k"].dataType))]))


def range_of(bounds: Column, key: Column, most: int) -> Column:
    """How many of at most ``most`` sorted bounds lie below the key: a binary search, as a pure function of the row."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(bounds, low + s - 1) < key, low + s).otherwise(low))


def running_sum(df: DataFrame, value: Column, name: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in a total order, for each key.

    The order is ascending, nulls first. Rows are dealt into ranges of (keys, order) by bounds that are fixed
    before, also within a key, and summed in their ranges; the sums of the ranges before are added. A row's range
    depends on the row and the bounds alone, so both looks at the rows, and a task that is run again, agree.
    """
    by = [*keys, *order]
    bounds = range_bounds(df, by)
    most = len(bounds.first()["__bounds"])
    placed = df.withColumn("__value", value).crossJoin(F.broadcast(bounds)).withColumn("__part", range_of(F.col("__bounds"), F.struct(*by), most)).drop("__bounds")
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("__part", *keys).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    same = F.col("a.__part") == F.col("b.__part")
    for k in keys:  # a null key is a key
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    told = placed.withColumn("__local", F.sum("__value").over(local)).alias("a").join(sums.alias("b"), same)
    return told.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__local") + F.col("b.__before")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Row numbers from 0 in a total order, to be written once at ingest.

    The order must be total, so that a second look gives the same numbers.
    """
    return running_sum(df, F.lit(1).cast("long"), "__n", order).withColumn(name, F.col("__n") - 1).drop("__n")


def positions(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows at places [start, stop) of a total order; bad bounds raise."""
    if not 0 <= start <= stop:
        raise ValueError(f"bad bounds: {start}, {stop}")
    return numbered(df, order, "__place").where((F.col("__place") >= start) & (F.col("__place") < stop)).drop("__place")


def range_labels(df: DataFrame, place: str, size: int) -> DataFrame:
    """``first-last`` labels, from 1, of fixed runs of rows by their number."""
    low = F.floor(F.col(place) / size) * size
    return df.withColumn("range", F.concat((low + 1).cast("string"), F.lit("-"), (low + size).cast("string")))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in both, in the first only and in the second only."""
    x, y = a.distinct().withColumn("__a", F.lit(1)), b.distinct().withColumn("__b", F.lit(1))
    both = x.join(y, a.columns, "full")
    return both.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"),
        F.count_if(F.col("__b").isNull()).alias("only_a"),
        F.count_if(F.col("__a").isNull()).alias("only_b"),
    )


def excluded(df: DataFrame, column: str, values: list, keep_null: bool = True) -> DataFrame:
    """Rows whose value is not listed; a null value stays unless told otherwise."""
    out = ~F.col(column).isin(values)
    return df.where(F.coalesce(out, F.lit(keep_null)))
