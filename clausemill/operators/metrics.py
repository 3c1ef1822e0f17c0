"""Masked classification metrics over the long form (row_id, topic_index, label, mask, prediction).

A cell with mask 0 is unknown, not negative: every count multiplies by the mask. All metrics are at most two
aggregations with map-side combining; the second one runs over one row a topic or class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def counts(predicted: Column, label: Column, mask: Column) -> list[Column]:
    """True positive, false positive, false negative and observed counts over cells whose mask is 1."""
    seen = F.coalesce(mask, F.lit(0.0)) == 1.0
    return [
        F.count_if(seen & predicted & label).alias("tp"),
        F.count_if(seen & predicted & ~label).alias("fp"),
        F.count_if(seen & ~predicted & label).alias("fn"),
        F.count_if(seen).alias("observed"),
    ]


def per_topic(cells: DataFrame, *extra: str) -> DataFrame:
    """Precision, recall, F1, support and observed cells of every topic with an observed cell."""
    label, predicted = F.col("label") == 1.0, F.col("prediction") == 1
    c = cells.groupBy(*extra, "topic_index").agg(*counts(predicted, label, F.col("mask"))).where("observed > 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *extra,
        "topic_index",
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
        "observed",
    )


def topic_summary(topics: DataFrame, *keys: str, least_support: int = 0) -> DataFrame:
    """Macro, micro and weighted F1 from a per-topic table; macro over topics of some support."""
    t = topics.where(F.col("support") >= least_support)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    own = t.groupBy(*keys) if keys else t
    return own.agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("topic_macro_f1"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("topic_micro_f1"),
        F.coalesce(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("topic_weighted_f1"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("micro_precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("micro_recall"),
        F.coalesce(F.sum("observed"), F.lit(0)).alias("observed"),
    )


def with_average_rows(topics: DataFrame) -> DataFrame:
    """The per-topic table with its ``macro avg`` and ``weighted avg`` rows; equal weights where no topic has support."""
    named = topics.select(F.col("topic_index").cast("string").alias("topic"), "precision", "recall", "f1", "support", "observed")
    weight = F.when(F.col("total") > 0, F.col("support")).otherwise(1)
    total = topics.agg(F.sum("support").alias("total"))
    measured = topics.crossJoin(F.broadcast(total))
    sums = measured.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
        F.sum("observed").alias("observed"),
    ).where("observed IS NOT NULL")
    row = lambda kind: sums.select(F.lit(f"{kind} avg").alias("topic"), *[F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")], "support", "observed")
    return named.unionByName(row("macro")).unionByName(row("weighted"))


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of (truth, predicted) pairs over rows where mask is 1 and both are known."""
    valid = rows.where((F.col("mask") == 1.0) & F.col("truth").isNotNull() & F.col("predicted").isNotNull())
    return valid.groupBy(*keys, "truth", "predicted").agg(F.count("*").alias("n"))


def class_table(conf: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1 and support of each class in truth or prediction, from confusion counts."""
    long = conf.select(*keys, "n", "truth", "predicted", F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class"))
    t, p = F.col("truth") == F.col("class"), F.col("predicted") == F.col("class")
    c = long.groupBy(*keys, "class").agg(*[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(a) for a, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*keys, "class", "tp", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def class_summary(conf: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy, majority share and valid rows; zeros for no rows."""
    classes = class_table(conf, *keys)
    own = classes.groupBy(*keys) if keys else classes
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.agg(
        zero(ratio(F.sum("tp"), F.sum("support"))).alias("accuracy"),
        zero(F.avg("f1")).alias("macro_f1"),
        zero(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))).alias("weighted_f1"),
        zero(F.avg(F.when(F.col("support") > 0, F.col("recall")))).alias("balanced_accuracy"),
        zero(ratio(F.max("support"), F.sum("support"))).alias("majority_share"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("valid_rows"),
    )


def cell_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """Supervised positive, supervised negative and unsupervised cells."""
    seen, label = F.col("mask") == 1.0, F.col("label") == 1.0
    own = cells.groupBy(*keys) if keys else cells
    return own.agg(
        F.count_if(seen & label).alias("positive"),
        F.count_if(seen & ~label).alias("negative"),
        F.count_if(~seen).alias("unsupervised"),
        ratio(F.count_if(seen & ~label), F.count_if(seen & label)).alias("negative_ratio"),
    )


def subset_accuracy(cells: DataFrame) -> DataFrame:
    """Share of rows whose observed cells are all right, predicted-positive rate and mean probability of observed cells."""
    seen = F.col("mask") == 1.0
    rows = cells.groupBy("row_id").agg(
        F.bool_and((F.col("prediction") == F.col("label")) | ~seen).alias("right"),
        F.count_if(seen).alias("seen"),
        F.count_if(seen & (F.col("prediction") == 1)).alias("positive"),
        F.sum(F.when(seen, F.col("probability"))).alias("probability"),
    )
    return rows.agg(
        F.avg(F.col("right").cast("double")).alias("subset_accuracy"),
        ratio(F.sum("positive"), F.sum("seen")).alias("positive_rate"),
        ratio(F.sum("probability"), F.sum("seen")).alias("mean_probability"),
    )


def masked_loss(cells: DataFrame) -> DataFrame:
    """Mean binary cross entropy of observed cells, from logits, in the form that does not overflow."""
    x, y = F.col("logit"), F.col("label")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return cells.where("mask = 1.0").agg(F.avg(loss).alias("loss"), F.count("*").alias("cells"))


def degenerate(cells: DataFrame, limit: float = 0.95) -> DataFrame:
    """Macro F1 of predicting every cell positive, and whether that alone reaches the limit."""
    all_positive = per_topic(cells.withColumn("prediction", F.lit(1)))
    return topic_summary(all_positive).select("topic_macro_f1", (F.col("topic_macro_f1") >= limit).alias("degenerate"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Agreement of two score columns a, b in -1, 0, 1: over valid rows, and the rows that differ with missing ones."""
    valid = F.col("a").isin(-1, 0, 1) & F.col("b").isin(-1, 0, 1)
    known = F.coalesce(valid, F.lit(False))
    return pairs.agg(
        F.count("*").alias("rows"),
        F.count_if(known).alias("valid_rows"),
        F.avg(F.when(known, (F.col("a") == F.col("b")).cast("double"))).alias("agreement"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"),
    )


def parity(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-3) -> DataFrame:
    """The largest difference of a metric between two tables, rows of one side only, and whether all is within tolerance."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full")
    return both.agg(
        F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("one_sided"),
    ).withColumn("within", (F.coalesce("largest", F.lit(0.0)) <= tolerance) & (F.col("one_sided") == 0))
