"""Classifiers and regressors: MLlib estimators with the settings the reports expect."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.constants import SEED
from reviewmill.operators.boosting import BoostedTrees, fit_boosted
from reviewmill.operators.lookup import lookup_join
from reviewmill.operators.svm import MAX_STEPS, LinearClassifier, fit_squared_hinge
from reviewmill.session import ensure_checkpoint_dir

VECTOR = "features"
ROWS_PER_TASK = 50_000


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector in the order of ``features``; names stay attached as column metadata."""
    return VectorAssembler(inputCols=features, outputCol=VECTOR).transform(df)


def pack(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Fewer, fuller partitions for iterative fits, where every round pays for every task.

    Partitions are only merged, never added: a large table keeps its own.
    """
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", totals / F.col("n"))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    weights = balanced_class_weights(df, label).select(F.col(label).alias("_label"), "weight")
    return lookup_join(df, weights, {label: "_label"})


def fit_linear_svc(train: DataFrame, label: str = "label", max_steps: int = MAX_STEPS) -> LinearClassifier:
    """One-vs-rest linear SVM with squared hinge loss, C = 1 and balanced weights."""
    rows = with_class_weights(train, label).withColumn(label, F.col(label).cast("double"))
    return fit_squared_hinge(pack(rows), label, "weight", max_steps=max_steps)


def fit_random_forest(train: DataFrame, label: str = "label", trees: int = 200, depth: int = 12):
    rows = with_class_weights(train, label).withColumn(label, F.col(label).cast("double"))
    ensure_checkpoint_dir(train.sparkSession)
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol=VECTOR,
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=2,
        featureSubsetStrategy="sqrt",
        seed=SEED,
        cacheNodeIds=True,  # rows are not sent down every tree from its root again for each group of nodes
        checkpointInterval=-1,  # node ids are kept, not written
    )
    return forest.fit(rows)


def fit_linear_regression(train: DataFrame, label: str):
    """Ordinary least squares on already scaled features."""
    return LinearRegression(
        labelCol=label, featuresCol=VECTOR, solver="normal", regParam=0.0, standardization=False
    ).fit(train)


def fit_boosted_regression(train: DataFrame, label: str, rounds: int = 200, depth: int = 6) -> BoostedTrees:
    """Second-order boosting with learning rate 0.1; four fifths of rows and columns are drawn once per tree."""
    return fit_boosted(train, label, rounds, 0.1, depth, 0.8, 0.8)


def feature_importance(df: DataFrame, model, features: list[str], top: int | None = None) -> DataFrame:
    """feature, importance: names follow the vector order the model was trained on."""
    scores = model.featureImportances.toArray()
    rows = sorted(zip(features, map(float, scores)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows[:top], "feature string, importance double")
