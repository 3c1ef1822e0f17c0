"""Linear probes: what a label gives away through length or embeddings alone."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over classes times the class's rows, so that every class weighs the same."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.select(label, "__n", F.sum("__n").over(Window.partitionBy()).alias("__all"), F.count("*").over(Window.partitionBy()).alias("__k"))
    return df.join(F.broadcast(total), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def linear_probe(df: DataFrame, label: str, numbers: list[str] = (), array: str | None = None, rounds: int = 100) -> DataFrame:
    """(row_id, truth, predicted, split): standardised features, balanced logistic regression fitted on train rows.

    ``df`` has row_id, split, the label as a whole number, and number columns or one array column.
    """
    told = df.withColumn("__raw", array_to_vector(F.col(array).cast("array<double>"))) if array else VectorAssembler(inputCols=list(numbers), outputCol="__raw").transform(df)
    train = told.where("split = 'train'")
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(train)
    weighted = balanced(scaler.transform(train).withColumn("label", F.col(label).cast("double")), "label")
    model = LogisticRegression(weightCol="weight", maxIter=rounds, regParam=1e-3).fit(weighted)
    return model.transform(scaler.transform(told)).select("row_id", F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), "split")
