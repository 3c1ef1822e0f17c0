"""Resampling statistics without shipping draws: replicate weights come from a seeded hash of (replicate, row).

The bootstrap gives each row a Poisson(1) weight in each replicate, so the size of a replicate is random with
the number of rows as its mean. A replicate's counts are weighted sums with map-side combining: the table is
read once for a block of replicates, and what is shuffled is one row a task, replicate and topic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators.metrics import ratio


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)) / F.lit(float(2**53))


def poisson_weight(u: Column, most: int = 9) -> Column:
    """The Poisson(1) quantile of a uniform number."""
    total, term, found = 0.0, math.exp(-1.0), F.lit(most)
    steps = []
    for k in range(most):
        total += term
        steps.append((total, k))
        term /= k + 1
    for bound, k in reversed(steps):
        found = F.when(u < bound, F.lit(k)).otherwise(found)
    return found


def replicated(rows: DataFrame, replicates: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Every row once for each replicate in which its weight is not 0, with ``replicate`` and ``weight``."""
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return each.withColumn("weight", poisson_weight(uniform(F.lit(seed), F.col("replicate"), F.col(row_id)))).where("weight > 0")


def weighted_f1(cells: DataFrame, *keys: str) -> DataFrame:
    """Macro and micro topic F1 for each replicate (and key) over weighted cells."""
    seen, label, guess = F.col("mask") == 1.0, F.col("label") == 1.0, F.col("prediction") == 1
    w = F.col("weight")
    c = cells.where(seen).groupBy(*keys, "replicate", "topic_index").agg(*[F.sum(F.when(x, w).otherwise(0)).alias(n) for n, x in (("tp", guess & label), ("fp", guess & ~label), ("fn", ~guess & label))])
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return c.groupBy(*keys, "replicate").agg(F.avg(f1).alias("macro_f1"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def bootstrap_interval(cells: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """metric, point, mean, ci_low, ci_high of macro and micro F1: percentiles 2.5 and 97.5 over the replicates."""
    point = weighted_f1(cells.withColumn("replicate", F.lit(-1)).withColumn("weight", F.lit(1)))
    draws = weighted_f1(replicated(cells, replicates, seed))
    long = lambda df: df.select("replicate", F.expr("stack(2, 'macro_f1', macro_f1, 'micro_f1', micro_f1) AS (metric, value)"))
    bounds = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    spread = long(draws).groupBy("metric").agg(F.avg("value").alias("mean"), bounds.alias("b"))
    return long(point).select("metric", F.col("value").alias("point")).join(spread, "metric").select("metric", "point", "mean", F.col("b")[0].alias("ci_low"), F.col("b")[1].alias("ci_high"))


def paired_delta(cells: DataFrame, replicates: int = 1000, seed: int = 42, metric: str = "macro_f1") -> DataFrame:
    """Difference of two models' metric (columns ``prediction_a`` and ``prediction_b``), on the same replicates.

    p is the share of replicates whose difference, centred, is at least as far from 0 as the observed one.
    """
    both = cells.withColumn("m", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("prediction_a").alias("p")), F.struct(F.lit("b").alias("model"), F.col("prediction_b").alias("p")))))
    both = both.select("row_id", "topic_index", "label", "mask", F.col("m.model").alias("model"), F.col("m.p").alias("prediction"))
    signed = F.sum(F.when(F.col("model") == "a", F.col(metric)).otherwise(-F.col(metric)))
    observed = weighted_f1(both.withColumn("replicate", F.lit(-1)).withColumn("weight", F.lit(1)), "model").agg(signed.alias("delta"))
    draws = weighted_f1(replicated(both, replicates, seed), "model").groupBy("replicate").agg(signed.alias("d"))
    centre = draws.agg(F.avg("d").alias("centre"))
    told = draws.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(observed))
    return told.agg(
        F.first("delta").alias("delta"),
        F.percentile("d", F.lit(0.025)).alias("ci_low"),
        F.percentile("d", F.lit(0.975)).alias("ci_high"),
        F.avg((F.abs(F.col("d") - F.col("centre")) >= F.abs("delta")).cast("double")).alias("p_value"),
        F.count("*").alias("replicates"),
    )


def binomial_p(b: int, n: int) -> float:
    """Two-sided exact p of b successes in n at one half."""
    if n == 0:
        return 1.0
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    own = log(b)
    return min(1.0, sum(math.exp(log(k)) for k in range(n + 1) if log(k) <= own + 1e-9))


def discordant(rows: DataFrame) -> DataFrame:
    """b and c: rows that only the first, and only the second model gets right (columns right_a, right_b)."""
    return rows.agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("b"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("c"))


def mcnemar(rows: DataFrame) -> dict[str, float]:
    """b, c and the exact two-sided p; two numbers come to the driver."""
    row = discordant(rows).first()
    return {"b": row["b"], "c": row["c"], "p_value": binomial_p(row["b"], row["b"] + row["c"])}


def seed_deltas(runs: DataFrame, t: float = 4.303) -> DataFrame:
    """Mean difference of two arms paired by seed, with t times its standard error, and whether all are positive.

    ``runs`` has (arm, seed, value) with arms a and b; seeds of one arm only are left out.
    """
    a, b = (runs.where(F.col("arm") == x).select("seed", F.col("value").alias(x)) for x in ("a", "b"))
    d = a.join(b, "seed").select("seed", (F.col("a") - F.col("b")).alias("d"))
    half = t * F.stddev_samp("d") / F.sqrt(F.count("*"))
    return d.agg(F.avg("d").alias("delta"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high"), F.bool_and(F.col("d") > 0).alias("all_positive"), F.count("*").alias("seeds"))


def overlapping(intervals: DataFrame) -> DataFrame:
    """For each pair of a few named intervals (name, lo, hi) whether they overlap. The table is one row a run."""
    a, b = intervals.alias("a"), intervals.alias("b")
    apart = F.expr("a.hi < b.lo OR a.lo > b.hi")
    return a.join(b, F.expr("a.name < b.name")).select(F.col("a.name").alias("first"), F.col("b.name").alias("second"), (~apart).alias("overlap"))
