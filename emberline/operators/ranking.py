"""Ranked candidates: metrics by case and split, margins, hybrid scores, ML ranking pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_in(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))


def rank_metrics(ranked: DataFrame, truth: DataFrame, key: str, split: str, k: int = 3) -> DataFrame:
    """Top-1, top-k and mean reciprocal rank of the true node, by split and over all (split null)."""
    of = ranked.join(truth, [key, "node"]).select(key, split, "rank")
    each = of.select(split, (F.col("rank") == 1).cast("double").alias("top1"), (F.col("rank") <= k).cast("double").alias("topk"), (1 / F.col("rank")).alias("rr"))
    return each.rollup(split).agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("topk"), 6).alias("topk"), F.round(F.avg("rr"), 6).alias("mrr"))


def margin(ranked: DataFrame, key: str, score: str) -> DataFrame:
    """The lead of each case's first candidate over its second, null if there is one only."""
    w = Window.partitionBy(key).orderBy("rank")
    return ranked.withColumn("margin", F.col(score) - F.lead(score).over(w)).where("rank = 1").select(key, "node", score, "margin")


def hybrid(df: DataFrame, key: str, model: str, context: str) -> DataFrame:
    """0.75 of the model's score and 0.25 of the context's share of its case's largest."""
    most = F.max(context).over(Window.partitionBy(key))
    return df.withColumn("hybrid", 0.75 * F.col(model) + 0.25 * F.when(most > 0, F.col(context) / most).otherwise(0.0))


def pipeline(categorical: list[str], numeric: list[str], trees: int = 200):
    """One-hot, scaling and a random forest on rows with ``label`` and ``weight``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    return Pipeline(
        stages=[
            StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical]),
            VectorAssembler(inputCols=numeric, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            VectorAssembler(inputCols=["scaled", *[f"{c}_v" for c in categorical]], outputCol="features"),
            RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=42),
        ]
    )


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: n / (classes * n of the class)."""
    total, by = df.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_k")), df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(F.broadcast(by), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_n", "_k", "_c")
