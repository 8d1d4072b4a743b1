"""From cleaned reviews to scaled, encoded and selected model data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.encoding import OneHotEncoder, cardinality, frequency_encode
from reviewmill.operators.features import distribution_stats, feature_list, model_rows, scaler_choice
from reviewmill.operators.scaling import LinearScaler, MedianImputer
from reviewmill.operators.selection import anova_f_scores, choose_k, k_best
from reviewmill.operators.splits import stratified_split
from reviewmill.session import write_stage


@dataclass(frozen=True)
class Preprocessor:
    """Imputer, scaler and encoder fitted on the training part only."""

    imputer: MedianImputer
    scaler: LinearScaler
    encoder: OneHotEncoder

    @classmethod
    def fit(
        cls, train: DataFrame, numeric: list[str], scaler: str, categorical: list[str] | None = None
    ) -> Preprocessor:
        imputer = MedianImputer.fit(train, numeric)
        fitted = LinearScaler.fit(imputer.transform(train.select(*numeric)), numeric, scaler)
        return cls(imputer, fitted, OneHotEncoder.fit(train, categorical or []))

    def names(self) -> list[str]:
        return [*self.imputer.medians, *self.encoder.names()]

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scaled = self.scaler.transform(self.imputer.transform(df))
        encoded = self.encoder.transform(scaled) if self.encoder.categories else scaled
        return encoded.select(*keep, *self.names())


@dataclass(frozen=True)
class ModelData:
    table: DataFrame  # key, dataset, target, selected features
    features: list[str]
    scores: DataFrame  # feature, position, score of the selected features
    metadata: DataFrame  # one row


def choose_encoders(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(one-hot columns, frequency columns) by the number of distinct values."""
    if not columns:
        return [], []
    kinds = {r["column_name"]: r["encoder"] for r in cardinality(df, columns).collect()}  # one per column
    return [c for c in columns if kinds[c] == "one_hot"], [c for c in columns if kinds[c] == "frequency"]


def training_part(df: DataFrame) -> DataFrame:
    return df.filter(F.col("dataset") == "train")


def prepare_model_data(
    features: DataFrame,
    key: str = "row_key",
    target: str = "sentiment_coarse",
    categorical: list[str] | None = None,
    scaler_fit_on: str = "all",
    k: int | None = None,
    scaler: str | None = None,
) -> ModelData:
    """Split, fit on the training part, transform all parts, and keep the K best features.

    Categorical columns with few values are one-hot encoded; the others become the share of rows that
    have the value, taken from the whole table. ``scaler_fit_on`` chooses whether the kind of scaler is
    decided on all rows or on ``train``; ``scaler`` fixes it. ``k`` is the number of features to keep, all by default.
    Only the key, the target and the model's own columns are split and written, not the texts.
    """
    numeric = feature_list(features)
    one_hot, frequency = choose_encoders(features, categorical or [])
    for column in frequency:
        features = frequency_encode(features, column)
        numeric = [*numeric, f"{column}_freq"]
    rows = model_rows(features, target).select(key, target, *numeric, *one_hot)
    split = write_stage(stratified_split(rows, target, [key]), "split")
    train = training_part(split)
    stats = distribution_stats(features if scaler_fit_on == "all" else train, numeric)
    choice = scaler_choice(stats).first()
    prep = Preprocessor.fit(train, numeric, scaler or choice["scaler"], one_hot)
    keep = [F.col(key), F.col("dataset"), F.col(target).alias("target")]
    matrix = write_stage(prep.transform(split, keep), "matrix")
    names = prep.names()
    sizes = {r["dataset"]: r["count"] for r in split.groupBy("dataset").count().collect()}
    k = choose_k(len(names), k)
    scores = k_best(anova_f_scores(training_part(matrix), names, "target"), k)
    ranked = [(r["feature"], r["position"], r["score"]) for r in scores.collect()]  # one per feature
    selected = [n for n in names if n in {f for f, _, _ in ranked}]
    spark = features.sparkSession
    meta = spark.createDataFrame(
        [
            (
                sum(sizes.values()), "classification", target, scaler or choice["scaler"], choice["reason"],
                float(choice["median_abs_skew"]), ",".join(one_hot), ",".join(frequency),
                sizes.get("train", 0), sizes.get("val", 0), sizes.get("test", 0),
                len(selected), len(names), ",".join(selected),
            )
        ],
        "total_rows bigint, problem_type string, target string, scaler string, scaler_reason string, "
        "median_abs_skew double, one_hot_columns string, frequency_columns string, train_rows bigint, val_rows bigint, "
        "test_rows bigint, k int, features_before int, selected_features string",
    )
    return ModelData(
        matrix.select(key, "dataset", "target", *selected),
        selected,
        spark.createDataFrame(ranked, "feature string, position int, score double"),
        meta,
    )


def stage_summary(cleaned: DataFrame, features: DataFrame, data: ModelData) -> DataFrame:
    """stage, rows, columns along the preparation."""
    meta = data.metadata.first()
    rows = F.count(F.lit(1))
    raw = cleaned.agg(F.lit("cleaned").alias("stage"), rows.alias("n_rows")).withColumn(
        "n_columns", F.lit(len(cleaned.columns))
    )
    engineered = model_rows(features).agg(F.lit("features").alias("stage"), rows.alias("n_rows"))
    engineered = engineered.withColumn("n_columns", F.lit(len(feature_list(features))))
    later = cleaned.sparkSession.createDataFrame(
        [
            ("train split", meta["train_rows"], meta["features_before"]),
            ("selected", meta["train_rows"], meta["k"]),
        ],
        "stage string, n_rows bigint, n_columns int",
    )
    return raw.unionByName(engineered).unionByName(later)
