"""Monthly ratings, sentiment mix and app releases.

Row data is grouped once per table; everything after that works on one row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.constants import DATE_CANDIDATES, SCORE_CANDIDATES, VERSION_CANDIDATES
from reviewmill.functions.casts import to_datetime, to_number
from reviewmill.functions.reviews import label_sentiment, major_version, month_end, versions_label
from reviewmill.operators.harmonize import resolve_column

SENTIMENTS = ("Negative", "Neutral", "Positive")


def trend_input(df: DataFrame) -> DataFrame:
    """Resolve columns by name, cast, and keep rows that have both a score and a date."""
    score = resolve_column(df, SCORE_CANDIDATES)
    date = resolve_column(df, DATE_CANDIDATES)
    version = resolve_column(df, VERSION_CANDIDATES, required=False)
    release = F.col(version).cast("string") if version else F.lit(None).cast("string")
    present = df.filter(F.col(score).isNotNull() & F.col(date).isNotNull())  # reaches the scan
    return present.select(
        to_number(F.col(score), df.schema[score].dataType).alias("score"),
        to_datetime(F.col(date), df.schema[date].dataType).alias("created_at"),
        release.alias("release"),
    ).filter(F.col("score").isNotNull() & F.col("created_at").isNotNull())


def monthly_mean_rating(df: DataFrame) -> DataFrame:
    monthly = trend_input(df).groupBy(month_end(F.col("created_at")).alias("year_month"))
    return monthly.agg(F.avg("score").alias("mean_score")).orderBy("year_month")


def sentiment_counts(df: DataFrame) -> DataFrame:
    """count per (month, sentiment) as observed."""
    sentiment = label_sentiment(F.col("score"), SENTIMENTS).alias("sentiment")
    grouped = trend_input(df).groupBy(month_end(F.col("created_at")).alias("year_month"), sentiment)
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def month_mix(df: DataFrame) -> DataFrame:
    """One row per month with the three sentiment counts: dense without any join."""
    label = label_sentiment(F.col("score"), SENTIMENTS)
    grouped = trend_input(df).groupBy(month_end(F.col("created_at")).alias("year_month"))
    return grouped.agg(*[F.count_if(label == s).alias(s) for s in SENTIMENTS])


def densify(df: DataFrame) -> DataFrame:
    """Every observed month with all three sentiments; absent ones count 0."""
    return month_mix(df).unpivot(["year_month"], list(SENTIMENTS), "sentiment", "n")


def share_within_month(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("year_month"))
    share = F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0))
    return counts.withColumn("prop", share)


def pivot_sentiment(df: DataFrame) -> DataFrame:
    shares = share_within_month(densify(df))
    wide = shares.groupBy("year_month").pivot("sentiment", list(SENTIMENTS)).agg(F.first("prop"))
    return wide.fillna(0.0, subset=list(SENTIMENTS)).orderBy("year_month")


def version_first_seen(df: DataFrame) -> DataFrame:
    """First date per major version. Rows are grouped by the raw text, which is parsed once per text."""
    releases = trend_input(df).groupBy("release").agg(F.min("created_at").alias("first_seen"))
    parsed = releases.select(major_version(F.col("release")).alias("major_version"), "first_seen")
    first = parsed.groupBy("major_version").agg(F.min("first_seen").alias("first_seen"))
    return first.filter(F.col("major_version").isNotNull()).withColumn("first_seen_month", month_end(F.col("first_seen")))


def first_seen_sample(df: DataFrame, n: int = 20) -> DataFrame:
    return version_first_seen(df).orderBy("first_seen", "major_version").limit(n)


def versions_by_month(df: DataFrame) -> DataFrame:
    """Sorted list of majors first seen in each month; input is one row per major."""
    grouped = version_first_seen(df).groupBy("first_seen_month")
    return grouped.agg(F.array_sort(F.collect_list("major_version")).alias("versions"))


def with_versions(months: DataFrame, df: DataFrame) -> DataFrame:
    """Left join month rows to their release list; both sides have one row per month."""
    releases = versions_by_month(df).withColumnRenamed("first_seen_month", "year_month")
    joined = months.join(releases, "year_month", "left")
    return joined.withColumn("versions_list", versions_label(F.col("versions"))).drop("versions")


def sentiment_trend(df: DataFrame) -> DataFrame:
    """Monthly sentiment shares with total count and the releases first seen that month."""
    mix = month_mix(df)
    total = sum((F.col(s) for s in SENTIMENTS), F.lit(0))
    shares = mix.select(
        "year_month",
        *[(F.col(s) / total).alias(s) for s in SENTIMENTS],
        total.cast("bigint").alias("total_count"),
    )
    return with_versions(shares, df).orderBy("year_month")


def month_coverage(df: DataFrame) -> DataFrame:
    """Number of months, first and last month, number of release months."""
    months = monthly_mean_rating(df).agg(
        F.count(F.lit(1)).alias("months"),
        F.min("year_month").alias("first_month"),
        F.max("year_month").alias("last_month"),
    )
    releases = versions_by_month(df).agg(F.count(F.lit(1)).alias("n"))
    return months.withColumn("release_months", releases.scalar())
