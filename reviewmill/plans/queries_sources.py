"""Queries: reading, writing, harmonizing and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.constants import SCRAPE_COLUMNS
from reviewmill.functions.casts import to_datetime, to_number
from reviewmill.operators import harmonize as hz
from reviewmill.operators.dedup import merge_newest
from reviewmill.operators.keywords import top_keywords
from reviewmill.operators.ordering import newest_first
from reviewmill.operators.quality import merge_summary
from reviewmill.plans import fixtures as fx
from reviewmill.plans.queries_trends import KEYWORD_FILES_SQL
from reviewmill.plans.registry import query
from reviewmill.plans.sql import MERGED, NEWEST, ONE_ID, from_stage, r6
from reviewmill.session import stage_path, write_stage
from reviewmill.sources import readers, writers
from reviewmill.streaming.master import ReviewArchive

_MERGED_COLUMNS = 'review_id, "user", content, score, thumbs_up, app_version, created_at, source'
_CLEANED_COLUMNS = (
    'review_id, "user", content, score, thumbs_up, thumbs_up_capped, app_version, created_at, source, '
    "content_len, is_very_long"
)
_CLEANED_SQL = from_stage("cleaned", f"SELECT {_CLEANED_COLUMNS.replace('thumbs_up_capped', r6('thumbs_up_capped'))} FROM cleaned")


def _csv_of_merged(spark, sf_dir):
    path = stage_path(spark, "merged-csv")
    writers.write_csv(fx.merged(spark, sf_dir), path)
    return path


def _typed(raw):
    return raw.withColumns(
        {
            "score": to_number(F.col("score")),
            "thumbs_up": to_number(F.col("thumbs_up")),
            "created_at": to_datetime(F.col("created_at")),
        }
    )


_MERGED_SQL = from_stage("merged", f"SELECT {_MERGED_COLUMNS} FROM merged")


@query("scan_reviews_csv", _MERGED_SQL)
def scan_reviews_csv(spark, sf_dir):
    return _typed(readers.read_csv(spark, _csv_of_merged(spark, sf_dir)))


@query("scan_reviews_csv_split", _MERGED_SQL)
def scan_reviews_csv_split(spark, sf_dir):
    """The same file, read by byte ranges although its values hold line breaks."""
    return _typed(readers.read_csv(spark, _csv_of_merged(spark, sf_dir), split=True))


@query("write_csv", from_stage("merged", """
SELECT count(*) AS n_rows, count(review_id) AS n_ids, count(content) AS n_content,
 CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(thumbs_up) AS BIGINT) AS votes FROM merged"""))
def write_csv(spark, sf_dir):
    back = _typed(readers.read_csv(spark, _csv_of_merged(spark, sf_dir)))
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("review_id").alias("n_ids"),
        F.count("content").alias("n_content"),
        F.sum(F.length("content")).alias("chars"),
        F.sum("thumbs_up").cast("bigint").alias("votes"),
    )


@query("scan_reviews_parquet", _CLEANED_SQL)
def scan_reviews_parquet(spark, sf_dir):
    return fx.cleaned(spark, sf_dir)


@query("write_parquet", _CLEANED_SQL)
def write_parquet(spark, sf_dir):
    path = stage_path(spark, "cleaned-twin")
    writers.write_twin(fx.cleaned_once(spark, sf_dir), path + "-csv", path + "-parquet")
    return readers.read_parquet(spark, path + "-parquet")


@query("load_with_fallback", _CLEANED_SQL)
def load_with_fallback(spark, sf_dir):
    path = stage_path(spark, "fallback")
    writers.write_parquet(fx.cleaned_once(spark, sf_dir), path)
    return readers.load_with_fallback(spark, table="no_such_review_table", parquet=path)


@query("select_source_file", "SELECT 'orders.parquet' AS file_name, count(*) AS n_rows FROM orders")
def select_source_file(spark, sf_dir):
    path = readers.select_source_file(spark, sf_dir, "ORDERS", exclude=("events",), pattern="*.parquet")
    rows = readers.read_parquet(spark, path).select(F.lit(path.rsplit("/", 1)[1]).alias("file_name"))
    return rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("parse_timestamps_on_read", from_stage("reviews", """
SELECT review_id, created_at AS "at" FROM reviews WHERE source = 'google_play'"""))
def parse_timestamps_on_read(spark, sf_dir):
    path = stage_path(spark, "scrape-csv")
    scrape = fx.scrape_source(fx.raw_reviews(spark, sf_dir))
    writers.write_csv(scrape.select(F.col("reviewId").alias("review_id"), "at"), path)
    return readers.read_csv(spark, path, dates=["at"])


@query("write_page_files", from_stage("merged", f"""
SELECT CAST(page_no AS INTEGER) AS page_no, count(*) AS n_rows, min(created_at) AS oldest, max(created_at) AS newest,
 min(rn) AS first_row, max(rn) AS last_row, 1 AS n_files, count(*) AS rows_in_place
FROM (SELECT *, (rn - 1) // 1500 + 1 AS page_no FROM (
 SELECT *, row_number() OVER (ORDER BY {NEWEST}, review_id NULLS FIRST) AS rn FROM merged))
GROUP BY page_no"""))
def write_page_files(spark, sf_dir):
    path = stage_path(spark, "pages")
    order = newest_first("created_at", "content", "user", "app_version", "source", "score", "thumbs_up", "review_id")
    writers.write_pages(fx.merged(spark, sf_dir), path, order, rows=1500)
    # a file is read by one task from top to bottom, so positions inside it are those of the file
    pages = readers.read_csv(spark, path, dates=["created_at"]).select(
        F.col("page_no").cast("int").alias("page_no"), "created_at", F.col("row_no").cast("bigint").alias("row_no"),
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("position"),
    )
    start = F.col("position") - F.col("row_no")
    in_place = pages.groupBy("page_no", "file", start.alias("start")).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
    )
    return in_place.groupBy("page_no").agg(
        F.sum("n").alias("n_rows"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
        F.count_distinct("file").cast("int").alias("n_files"), F.max("n").alias("rows_in_place"),
    )


_TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()


@query("file_inventory", "\nUNION ALL ".join(
    f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows, true AS has_size, true AS has_time FROM {t}" for t in _TABLES
))
def file_inventory(spark, sf_dir):
    found = writers.file_inventory(spark, sf_dir)
    return found.select(
        "file_name",
        "n_rows",
        (F.col("size_mb") > 0).alias("has_size"),
        F.col("modified_at").isNotNull().alias("has_time"),
    )


@query("write_keyword_csvs", KEYWORD_FILES_SQL)
def write_keyword_csvs(spark, sf_dir):
    path = stage_path(spark, "keywords")
    writers.write_keyword_csvs(top_keywords(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir)), path)
    return readers.read_csv(spark, path).withColumn("n", F.col("n").cast("bigint"))


@query("harmonize_columns", from_stage("reviews", """
SELECT review_id, "user", content, score, CAST(thumbs_up AS DOUBLE) AS thumbs_up, app_version, created_at, source
FROM reviews WHERE source = 'kaggle'"""))
def harmonize_columns(spark, sf_dir):
    return hz.harmonize_columns(fx.file_source(fx.raw_reviews(spark, sf_dir)), "kaggle")


@query("resolve_column", "SELECT count(*) AS n_rows, count(DISTINCT o_orderdate) AS n_dates FROM orders")
def resolve_column(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    renamed = orders.withColumnsRenamed({"o_orderdate": "Date", "o_totalprice": "Rate"})
    date = hz.resolve_column(renamed, ["created_at", "date"])
    return renamed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date).alias("n_dates"))


@query("resolve_target", from_stage("cleaned", f"SELECT 'score' AS target, {r6('avg(score)', 'mean_target')} FROM cleaned"))
def resolve_target(spark, sf_dir):
    df = fx.cleaned_short(spark, sf_dir)
    target = hz.resolve_target(df)
    return df.agg(F.avg(target).alias("mean_target")).select(F.lit(target).alias("target"), "mean_target")


@query("select_numeric_columns", from_stage("cleaned", f"""
SELECT score, thumbs_up, {r6('thumbs_up_capped')}, content_len FROM cleaned"""))
def select_numeric_columns(spark, sf_dir):
    df = fx.cleaned_short(spark, sf_dir)
    return df.select(*hz.numeric_columns(df))


_MESSY = """
messy AS (
 SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'x' WHEN 1 THEN concat(' ', v, ' ') WHEN 2 THEN concat(v, 'd')
  WHEN 3 THEN concat(v, 'e2') WHEN 4 THEN concat('0x', v) WHEN 5 THEN concat(v, '_0') WHEN 6 THEN concat('-', v, '.5')
  ELSE v END AS raw
 FROM (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events))"""


@query("to_numeric_coerce", f"""
WITH {_MESSY}
SELECT event_id, CASE WHEN regexp_matches(raw, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
 THEN CAST(trim(raw) AS DOUBLE) END AS number FROM messy""")
def to_numeric_coerce(spark, sf_dir):
    v = F.floor("value").cast("bigint").cast("string")
    shape = F.col("event_id") % 8
    raw = (
        F.when(shape == 0, "x")
        .when(shape == 1, F.concat(F.lit(" "), v, F.lit(" ")))
        .when(shape == 2, F.concat(v, F.lit("d")))
        .when(shape == 3, F.concat(v, F.lit("e2")))
        .when(shape == 4, F.concat(F.lit("0x"), v))
        .when(shape == 5, F.concat(v, F.lit("_0")))
        .when(shape == 6, F.concat(F.lit("-"), v, F.lit(".5")))
        .otherwise(v)
    )
    return fx.table(spark, sf_dir, "events").select("event_id", to_number(raw).alias("number"))


@query("to_datetime_coerce", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts)
 END AS parsed FROM events""")
def to_datetime_coerce(spark, sf_dir):
    ts, shape = F.col("ts"), F.col("event_id") % 4
    raw = (
        F.when(shape == 0, ts.cast("string"))
        .when(shape == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(shape == 2, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("day "), ts.cast("string")))
    )
    return fx.table(spark, sf_dir, "events").select("event_id", to_datetime(raw).alias("parsed"))


@query("project_scrape_columns", from_stage("reviews", """
SELECT review_id AS "reviewId", "user" AS "userName", content, CAST(score AS INTEGER) AS score,
 CAST(thumbs_up AS INTEGER) AS "thumbsUpCount", app_version AS "reviewCreatedVersion", created_at AS "at",
 app_version AS "appVersion" FROM reviews WHERE source = 'google_play'"""))
def project_scrape_columns(spark, sf_dir):
    raw = fx.scrape_source(fx.raw_reviews(spark, sf_dir)).withColumn("replyContent", F.lit(None))
    return hz.project_scrape_columns(raw.select("replyContent", *reversed(SCRAPE_COLUMNS)))


@query("fill_anonymous_user", from_stage("reviews", 'SELECT review_id, "user", source, created_at FROM merged', MERGED))
def fill_anonymous_user(spark, sf_dir):
    raw = fx.raw_reviews(spark, sf_dir).drop("event_id")
    return hz.fill_anonymous_user(raw).select("review_id", "user", "source", "created_at")


@query("add_constant_column", "SELECT event_id, event_type, 'events' AS origin FROM events")
def add_constant_column(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    return hz.add_constant_column(events, "origin", "events")


@query("union_sources", from_stage("reviews", """
SELECT review_id, "user", content, score, CAST(thumbs_up AS DOUBLE) AS thumbs_up, app_version, created_at, source
FROM reviews"""))
def union_sources(spark, sf_dir):
    raw = fx.raw_reviews(spark, sf_dir)
    return hz.union_sources(
        hz.harmonize_columns(fx.scrape_source(raw), "google_play"),
        hz.harmonize_columns(fx.file_source(raw), "kaggle"),
    )


@query("merge_summary", from_stage("reviews", """
SELECT source, count(*) AS n FROM reviews GROUP BY source UNION ALL SELECT 'total', count(*) FROM reviews"""))
def merge_summary_query(spark, sf_dir):
    return merge_summary(fx.merged(spark, sf_dir))


@query("merge_sources", _MERGED_SQL)
def merge_sources(spark, sf_dir):
    return fx.build_merged(fx.raw_reviews(spark, sf_dir))


_NEWEST_SQL = from_stage("merged", f"""
SELECT {_MERGED_COLUMNS} FROM (
 SELECT *, row_number() OVER (PARTITION BY {ONE_ID} ORDER BY {NEWEST}) AS rn FROM merged) WHERE rn = 1""")


@query("merge_master_newest", _NEWEST_SQL)
def merge_master_newest(spark, sf_dir):
    rows = fx.merged(spark, sf_dir)
    store = F.col("source") == "google_play"
    return merge_newest(rows.filter(store), rows.filter(~store))


def _write_arrivals(rows, path, files):
    """The rows as ``files`` files; a table of enough partitions is not shuffled for that."""
    dealt = rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)
    dealt.write.option("compression", "zstd").parquet(path)


@query("stream_merge_master", _NEWEST_SQL)
def stream_merge_master(spark, sf_dir):
    rows = fx.merged(spark, sf_dir)
    inbox = stage_path(spark, "inbox")
    _write_arrivals(rows, inbox, 4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    archive = ReviewArchive(spark, stage_path(spark, "archive"))
    archive.stream_from(stream).awaitTermination()
    archive.compact()
    return archive.read()


@query("stream_merge_tiered", _NEWEST_SQL)
def stream_merge_tiered(spark, sf_dir):
    """Merged after every second micro-batch, with levels that small tables reach too; the last batch is read unmerged."""
    rows = fx.merged(spark, sf_dir)
    inbox = stage_path(spark, "inbox")
    _write_arrivals(rows, inbox, 7)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    archive = ReviewArchive(spark, stage_path(spark, "archive"), buckets=8, fanout=2, level_rows=100)
    archive.stream_from(stream, compact_every=2).awaitTermination()
    return archive.read()


@query("write_feature_splits", from_stage("split", """
SELECT dataset, sentiment_coarse AS target, count(*) AS n FROM split GROUP BY 1, 2"""))
def write_feature_splits(spark, sf_dir):
    path = stage_path(spark, "splits")
    writers.write_feature_splits(fx.model_data(spark, sf_dir).table, path)
    return readers.read_parquet(spark, path).groupBy("dataset", "target").agg(F.count(F.lit(1)).alias("n"))


@query("write_run_metadata", from_stage("split", """
SELECT count(*) AS total_rows, count(*) FILTER (dataset = 'train') AS train_rows,
 count(*) FILTER (dataset = 'val') AS val_rows, count(*) FILTER (dataset = 'test') AS test_rows FROM split"""))
def write_run_metadata(spark, sf_dir):
    path = stage_path(spark, "metadata")
    writers.write_run_metadata(fx.model_data(spark, sf_dir).metadata, path)
    return spark.read.json(path).select("total_rows", "train_rows", "val_rows", "test_rows")
