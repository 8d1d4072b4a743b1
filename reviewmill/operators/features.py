"""Engineered review features and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.constants import (
    BASE_FEATURES,
    MINORITY_WARNING_PCT,
    REQUIRED_FEATURES,
    SKEW_HIGH,
    TEMPORAL_FEATURES,
)
from reviewmill.functions import text as tx
from reviewmill.functions.casts import to_number
from reviewmill.functions.reviews import (
    day_of_week,
    engagement_per_word,
    label_sentiment,
    skew_label,
    skew_scaler,
    whole_days,
    words_per_punct,
)
from reviewmill.operators.order_stats import exact_medians, exact_quantiles
from reviewmill.operators.quality import share_table


def votes_feature(df: DataFrame) -> Column:
    """Capped votes if the table has them, else raw votes, else 0; missing is 0; whole number."""
    name = next((c for c in ("thumbs_up_capped", "thumbs_up") if c in df.columns), None)
    if name is None:
        return F.lit(0).cast("bigint")
    number = to_number(F.col(name), df.schema[name].dataType)
    return F.coalesce(number, F.lit(0.0)).cast("bigint")


def text_features(df: DataFrame) -> DataFrame:
    """The five engineered columns that need the text."""
    content = F.col("content")
    counts, chars = tx.text_counts(content), F.length(content)
    words = counts["words"]
    return df.withColumns(
        {
            "content_len_chars": chars.cast("bigint"),
            "content_len_words": words,
            "punct_count": counts["punct"].cast("int"),
            "upper_ratio": counts["upper"] / F.greatest(chars, F.lit(1)),
            "avg_word_len": F.when(words > 0, counts["letters"] / words).when(words == 0, F.lit(0.0)),
        }
    )


def engineer_features(
    df: DataFrame, fit_on: DataFrame | None = None, texts: DataFrame | None = None, key: str = "_row"
) -> DataFrame:
    """Cleaned reviews plus fifteen engineered columns.

    The first date is one uncorrelated scalar subquery over the date column; ``fit_on`` takes it
    from another table, for instance the training part. With ``texts`` (``key``, ``content``) the reviews carry ``key``
    in place of the text, and what is measured of a text goes to them, not the text.
    """
    sized = text_features(df) if texts is None else df.join(text_features(texts).drop("content"), key)
    return derived_features(sized, df if fit_on is None else fit_on)


def derived_features(sized: DataFrame, fit_on: DataFrame) -> DataFrame:
    """The ten engineered columns that follow from those of the text and the short columns."""
    first_date = fit_on.agg(F.min("created_at")).scalar()
    created = F.col("created_at")
    sized = sized.withColumns(
        {
            "thumbs_up_feat": votes_feature(sized),
            "year": F.year(created),
            "month": F.month(created),
            "day_of_week": day_of_week(created),
            "days_since_first": whole_days(first_date, created),
            "sentiment_coarse": label_sentiment(F.col("score")),
        }
    )
    words, punct, votes = (F.col(c) for c in ("content_len_words", "punct_count", "thumbs_up_feat"))
    return sized.withColumns(
        {
            "log_thumbs_up": F.log1p(votes),
            "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
            "words_per_punct": words_per_punct(words, punct),
            "engagement_per_word": engagement_per_word(votes, words),
        }
    )


def feature_list(df: DataFrame) -> list[str]:
    """Matrix columns present in the table, in matrix order."""
    names = BASE_FEATURES + (TEMPORAL_FEATURES if "days_since_first" in df.columns else [])
    return [n for n in names if n in df.columns]


def model_rows(df: DataFrame, target: str = "sentiment_coarse") -> DataFrame:
    """Rows with a target and the first five features."""
    return df.dropna(subset=[target, *feature_list(df)[:REQUIRED_FEATURES]])


def _corrected_skew(c: str) -> Column:
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)  # rounding in the moments must not make a constant look skewed
    population = F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(c), F.lit(0.0)))
    return F.when(n >= 3, population * F.sqrt(n * (n - 1)) / (n - 2))


def distribution_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """mean, median, std, skewness, min, max: one row per feature from one aggregate."""
    features = feature_list(df) if features is None else features
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    medians = exact_medians(wide, features)
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.avg(f).alias("mean"),
            F.lit(medians[f]).cast("double").alias("median"),
            F.stddev_samp(f).alias("std"),
            _corrected_skew(f).alias("skewness"),
            F.min(f).alias("min"),
            F.max(f).alias("max"),
        )
        for f in features
    ]
    return wide.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def skew_interpretation(stats: DataFrame) -> DataFrame:
    skew = F.coalesce("skewness", F.lit(0.0))
    return stats.select(
        "feature", "skewness", skew_label(skew).alias("shape"), skew_scaler(skew).alias("scaler")
    )


def scaler_choice(stats: DataFrame) -> DataFrame:
    """One row: median and mean of |skew| over the features, and the scaler they call for."""
    size = F.abs(F.coalesce("skewness", F.lit(0.0)))
    row = stats.agg(F.median(size).alias("median_abs_skew"), F.avg(size).alias("mean_abs_skew"))
    low = F.col("median_abs_skew") < SKEW_HIGH
    return row.withColumn("scaler", F.when(low, "standard").otherwise("minmax")).withColumn(
        "reason",
        F.when(low, "median |skew| below 1: roughly symmetric").otherwise(
            "median |skew| at or above 1: skewed"
        ),
    )


def class_distribution(df: DataFrame, label: str = "sentiment_coarse") -> DataFrame:
    """Label counts and shares; labels missing in the table stay in the denominator."""
    shares = share_table(df, label)
    return shares.withColumn("is_minority", F.col("pct") < MINORITY_WARNING_PCT)


def feature_means(df: DataFrame) -> DataFrame:
    """Progress figures: means and medians of the main engineered columns."""
    medians = exact_medians(df, ["content_len_chars", "thumbs_up_feat"])
    return df.agg(
        F.avg("content_len_chars").alias("mean_chars"),
        F.lit(medians["content_len_chars"]).cast("double").alias("median_chars"),
        F.avg("content_len_words").alias("mean_words"),
        F.avg("avg_word_len").alias("mean_word_len"),
        F.avg("upper_ratio").alias("mean_upper_ratio"),
        F.avg("thumbs_up_feat").alias("mean_votes"),
        F.lit(medians["thumbs_up_feat"]).cast("double").alias("median_votes"),
        F.count_if(F.col("is_weekend") == 1).alias("weekend_reviews"),
        F.avg("is_weekend").alias("weekend_share"),
        F.avg("words_per_punct").alias("mean_words_per_punct"),
        F.avg("engagement_per_word").alias("mean_engagement"),
    )


def describe_features(df: DataFrame, features: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max: one row per feature."""
    quartiles = exact_quantiles(df, {f: F.col(f) for f in features}, [0.25, 0.5, 0.75])
    stats = []
    for f in features:
        q1, q2, q3 = (F.lit(v).cast("double") for v in quartiles[f])
        value = F.col(f).cast("double")
        stats.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                q1.alias("p25"),
                q2.alias("p50"),
                q3.alias("p75"),
                F.max(value).alias("max"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def nan_inf_check(df: DataFrame, features: list[str], split: str = "dataset") -> DataFrame:
    """Missing (NULL or NaN) and infinite values per split, over all features in one pass."""
    values = [F.col(f).cast("double") for f in features]
    bad = sum((F.coalesce(F.isnan(v) | v.isNull(), F.lit(True)).cast("bigint") for v in values), F.lit(0))
    inf = sum((F.coalesce(F.abs(v) == float("inf"), F.lit(False)).cast("bigint") for v in values), F.lit(0))
    return df.groupBy(split).agg(F.sum(bad).alias("n_missing"), F.sum(inf).alias("n_infinite"))


def scaling_verification(train: DataFrame, features: list[str], tolerance: float = 0.1) -> DataFrame:
    """Mean of feature means and of population standard deviations, checked against 0 and 1."""
    width = float(len(features))
    row = train.agg(
        (sum((F.avg(f) for f in features), F.lit(0.0)) / width).alias("mean_of_means"),
        (sum((F.stddev_pop(f) for f in features), F.lit(0.0)) / width).alias("mean_of_stds"),
    )
    ok = (F.abs("mean_of_means") < tolerance) & (F.abs(F.col("mean_of_stds") - 1) < tolerance)
    return row.withColumn("verified", ok)
