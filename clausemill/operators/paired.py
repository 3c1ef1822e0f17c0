"""Paired comparisons: moments, signed ranks and their tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.operators.relational import running_sum


def moments(pairs: DataFrame, *keys: str, higher_is_better: bool = True) -> DataFrame:
    """n, means, mean difference, paired effect size, t statistic and share improved, of columns before and after."""
    d = F.col("after") - F.col("before")
    known = pairs.where(F.col("before").isNotNull() & F.col("after").isNotNull() & ~F.isnan("before") & ~F.isnan("after"))
    own = known.groupBy(*keys) if keys else known
    sd = F.stddev_samp(d)
    return own.agg(
        F.count("*").alias("n"),
        F.avg("before").alias("before_mean"),
        F.avg("after").alias("after_mean"),
        F.avg(d).alias("mean_difference"),
        F.when(sd > 0, F.avg(d) / sd).alias("cohens_d"),
        F.when(sd > 0, F.avg(d) / (sd / F.sqrt(F.count("*")))).alias("t_statistic"),
        F.avg(((d > 0) if higher_is_better else (d < 0)).cast("double")).alias("share_improved"),
    )


def average_ranks(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds ``rank``: equal values share the mean of their places.

    Places are running sums of the counts of distinct values, dealt by range.
    """
    sizes = values.groupBy(*keys, value).agg(F.count("*").alias("__peers"))
    through = running_sum(sizes, F.col("__peers"), "__through", [value], list(keys))
    ranked = through.withColumn("rank", F.col("__through") - F.col("__peers") + (F.col("__peers") + 1) / 2).drop("__peers", "__through")
    return values.join(ranked, [*keys, value])


def signed_ranks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Sums of the ranks of rising and falling pairs, and the rank-biserial effect; pairs without change are left out."""
    d = pairs.select(*keys, (F.col("after") - F.col("before")).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    ranked = average_ranks(d, "size", *keys)
    own = ranked.groupBy(*keys) if keys else ranked
    up, down = F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))
    return own.agg(F.count("*").alias("n"), up.alias("rank_up"), down.alias("rank_down"), F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0)).alias("rank_biserial"))


def signed_rank_p(n: int, least: float, ties: list[int] = ()) -> float:
    """Two-sided p of the smaller rank sum: exact without ties for small n, else by the normal approximation."""
    if n == 0:
        return 1.0
    if n <= 25 and not any(t > 1 for t in ties):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    return math.erfc(abs(least - mean) / math.sqrt(2 * variance)) if variance else 1.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_p(t: float, freedom: int) -> float:
    """Two-sided p of Student's t."""
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def paired_test(pairs: DataFrame, normal: bool, higher_is_better: bool = True) -> dict:
    """The paired t test, or the signed-rank test where differences are not taken as normal; few numbers reach the driver."""
    m = moments(pairs, higher_is_better=higher_is_better).first().asDict()
    if m["n"] < 3:
        return {"n": m["n"], "test": "insufficient data"}
    if normal:
        return m | {"test": "paired t-test", "statistic": m["t_statistic"], "p_value": t_p(m["t_statistic"], m["n"] - 1) if m["t_statistic"] is not None else 1.0, "effect_size": m["cohens_d"]}
    r = signed_ranks(pairs).first().asDict()
    size = F.abs(F.col("after") - F.col("before")).alias("size")
    ties = [t["count"] for t in pairs.select(size).where("size != 0").groupBy("size").count().where("count > 1").groupBy("count").agg(F.count("*").alias("k")).collect() for _ in range(t["k"])]
    least = min(r["rank_up"] or 0.0, r["rank_down"] or 0.0)
    return m | {"test": "Wilcoxon signed-rank", "statistic": least, "p_value": signed_rank_p(r["n"], least, ties), "effect_size": r["rank_biserial"]}


def by_strata(pairs: DataFrame, *strata: str) -> DataFrame:
    """Moments of all pairs and of every value of each stratum column, in one pass over the rows."""
    names = F.array(F.lit("all"), *[F.concat(F.lit(f"{s}="), F.coalesce(F.col(s).cast("string"), F.lit("null"))) for s in strata])
    return moments(pairs.withColumn("stratum", F.explode(names)), "stratum")
