"""Review-like tables derived from the given tables, and their stages.

No given table holds app reviews, so ``reviews`` joins every event with the whole text of a document
and plants null ids, placeholder users, markup, links and missing values. The text of SQL twin of each
stage lives in ``sql.py``. Stages are written once per application to the shared folder, like the
files handed from one job to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.constants import REVIEW_COLUMNS
from reviewmill.operators.features import engineer_features
from reviewmill.operators.harmonize import project_final_columns
from reviewmill.operators.keywords import annotate_keywords, count_keywords
from reviewmill.operators.ordering import WIDE_ROWS, parts_of
from reviewmill.plans.cleaning import clean_rows, keyed_rows, merge_sources, unique_facts, with_text
from reviewmill.plans.modeling import ModelData, prepare_model_data
from reviewmill.session import write_stage

_stages: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews_from(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One review per event; the text is the whole document plus a planted ending.

    The narrow events are spread before the join: a small file is one task, and ten reviews share
    each text, so the joined rows would otherwise be made, and stay, in few partitions.
    """
    i = F.col("event_id")
    total = documents.agg(F.count(F.lit(1))).scalar()
    tasks = parts_of(events, WIDE_ROWS)
    spread = events.withColumn("doc_id", i % total).repartition(tasks, "doc_id")
    joined = spread.join(documents.select("doc_id", "text"), "doc_id", "left")
    ending = (
        F.when(F.col("event_type") == "error", " app crash &amp; bug http://x.io/a")
        .when(F.col("event_type") == "purchase", " Great VIDEO filter \U0001f600")
        .when(F.col("event_type") == "view", " Broken UI!!")
        .otherwise("")
    )
    number = lambda c: c.cast("string")
    score = (
        F.when(i % 89 == 0, None)
        .when(i % 10 < 3, 1)
        .when(i % 10 == 3, 2)
        .when(i % 10 == 4, 3)
        .when(i % 10 == 5, 4)
        .otherwise(5)
    )
    return joined.select(
        F.when(i % 97 != 0, F.concat(F.lit("r"), number(i - F.when(i % 20 == 1, 1).otherwise(0)))).alias(
            "review_id"
        ),
        F.when(i % 13 == 0, "Google User")
        .when(i % 17 != 0, F.concat(F.lit("u"), number(F.col("user_id"))))
        .alias("user"),
        F.when(i % 101 == 0, None).when(i % 103 == 0, "   ").otherwise(F.concat("text", ending)).alias("content"),
        score.cast("double").alias("score"),
        F.when(i % 53 != 0, F.floor("value").cast("bigint")).alias("thumbs_up"),
        F.when(
            i % 31 != 0, F.concat(F.lit("v"), number(30 + i % 12), F.lit(".1."), number(i % 5))
        ).alias("app_version"),
        F.when(
            i % 211 != 0, F.col("ts") + F.make_dt_interval((F.lit(30) * (i % 12)).cast("int"))
        ).alias("created_at"),
        F.when(i % 5 < 2, "google_play").otherwise("kaggle").alias("source"),
        i.alias("event_id"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_from(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents"))


def scrape_source(df: DataFrame) -> DataFrame:
    """The store half under its raw column names."""
    return df.filter(F.col("source") == "google_play").select(
        F.col("review_id").alias("reviewId"),
        F.col("user").alias("userName"),
        "content",
        F.col("score").cast("int").alias("score"),
        F.col("thumbs_up").cast("int").alias("thumbsUpCount"),
        F.col("app_version").alias("reviewCreatedVersion"),
        F.col("created_at").alias("at"),
        F.col("app_version").alias("appVersion"),
    )


def file_source(df: DataFrame) -> DataFrame:
    """The file half under other raw names, everything as text."""
    return df.filter(F.col("source") == "kaggle").select(
        F.col("review_id").alias("ID"),
        F.col("user").alias("author"),
        F.col("content").alias("Review"),
        F.col("score").cast("string").alias("Rating"),
        F.col("thumbs_up").cast("string").alias("likes"),
        F.col("app_version").alias("version"),
        F.col("created_at").cast("string").alias("date"),
    )


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = build()
    return _stages[key]


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "reviews", lambda: write_stage(reviews(spark, sf_dir), "reviews"))


def build_merged(df: DataFrame) -> DataFrame:
    return merge_sources({"google_play": scrape_source(df), "kaggle": file_source(df)})


def _known(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The stage if it has been written, else its plan: a text that is read once need not be written before."""
    found = _stages.get((spark.sparkContext.applicationId, sf_dir, name))
    return plan(spark, sf_dir) if found is None else found


def _merged_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_merged(_known(spark, sf_dir, "reviews", reviews))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "merged", lambda: write_stage(_merged_plan(spark, sf_dir), "merged"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "clean", lambda: keyed_rows(clean_rows(_known(spark, sf_dir, "merged", _merged_plan)))
    )


def clean_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged rows with cleaned text, before anything is dropped or deduplicated."""
    return _keyed(spark, sf_dir).select(*REVIEW_COLUMNS)


def cleaned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table without its text, with ``row_key``; ``_row`` leads back to the text."""
    return _once(spark, sf_dir, "facts", lambda: unique_facts(_keyed(spark, sf_dir)))


def _cleaned_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _keyed(spark, sf_dir).select("_row", "content")
    return project_final_columns(with_text(cleaned_facts(spark, sf_dir), texts))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "cleaned", lambda: write_stage(_cleaned_plan(spark, sf_dir), "cleaned"))


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_row`` and ``content`` of all cleaned rows with a text, as they were written."""
    return _keyed(spark, sf_dir).filter("_text").select("_row", "content")


def cleaned_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table but for its text: no text is shuffled or written again for queries that read none."""
    return project_final_columns(cleaned_facts(spark, sf_dir))


def cleaned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table for a query that reads it once: the stage if it has been written, else its plan."""
    return _known(spark, sf_dir, "cleaned", _cleaned_plan)


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword counts, written once for all reports. Texts are searched where they lie; only the hits meet the kept rows."""

    def build() -> DataFrame:
        found = annotate_keywords(_keyed(spark, sf_dir).filter("_text").select("_row", "score", "content")).drop("content")
        kept = found.join(cleaned_facts(spark, sf_dir).select("_row"), "_row", "left_semi")
        return write_stage(count_keywords(kept), "keyword-counts")

    return _once(spark, sf_dir, "keywords", build)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, numbers and short columns only: the text stays in the cleaned stage."""

    def build() -> DataFrame:
        made = engineer_features(cleaned_facts(spark, sf_dir).drop("user"), texts=kept_texts(spark, sf_dir)).drop("_row")
        return write_stage(made, "features")

    return _once(spark, sf_dir, "features", build)


def model_data(spark: SparkSession, sf_dir: str) -> ModelData:
    return _once(spark, sf_dir, "model", lambda: prepare_model_data(features(spark, sf_dir)))


def forget_stages() -> None:
    """Make the next query build its stages anew."""
    _stages.clear()
