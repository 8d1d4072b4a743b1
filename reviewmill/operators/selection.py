"""Feature scores and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anova_f_scores(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature, from count, mean and variance per class.

    One aggregate over the rows; the rest works on (class, feature) pairs.
    """
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(i).alias("position"),
            F.count(f).alias("n"),
            F.avg(F.col(f).cast("double")).alias("m"),
            F.var_pop(F.col(f).cast("double")).alias("v"),
        )
        for i, f in enumerate(features)
    ]
    labelled = train.filter(F.col(label).isNotNull())
    per_class = labelled.groupBy(label).agg(F.array(*stats).alias("s")).select(label, F.inline("s"))
    whole = Window.partitionBy("feature")
    centred = per_class.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole))
    sums = centred.groupBy("feature", "position").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    f_value = F.try_divide(
        F.try_divide(F.col("between"), F.col("k") - 1),
        F.try_divide(F.col("within"), F.col("rows") - F.col("k")),
    )
    return sums.select("feature", "position", f_value.alias("score"))


def choose_k(features: int, wanted: int | None = None) -> int:
    """The wanted number of features, at most all of them; all by default, however many rows there are."""
    return features if wanted is None else max(0, min(wanted, features))


def k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores, best first; one row per feature goes in."""
    return scores.orderBy(F.col("score").desc_nulls_last(), F.col("position").desc()).limit(k)


def select_k_best(train: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """Names of the k best features in their original order."""
    chosen = {r["feature"] for r in k_best(anova_f_scores(train, features, label), k).collect()}
    return [f for f in features if f in chosen]
