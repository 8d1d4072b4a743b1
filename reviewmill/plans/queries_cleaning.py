"""Queries: text cleaning, filters, deduplication, order and quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import reviews as rv
from reviewmill.functions import text as tx
from reviewmill.operators import dedup as dd
from reviewmill.operators import filters as fl
from reviewmill.operators import ordering as od
from reviewmill.operators import quality as ql
from reviewmill.operators.harmonize import project_final_columns
from reviewmill.plans import fixtures as fx
from reviewmill.plans import sql as sq
from reviewmill.plans.cleaning import clean_reviews, clean_rows
from reviewmill.plans.registry import query
from reviewmill.plans.sql import NEWEST, from_stage, r6

_TEXT_TIES = ("content", "user", "app_version", "source", "score", "thumbs_up")
_HAS = sq.HAS_TEXT.format("content")


def _per_review(fn):
    """Apply a text function to every raw review."""

    def run(spark, sf_dir):
        raw = fx.raw_reviews(spark, sf_dir)
        return raw.select("event_id", fn(F.col("content")).alias("result"))

    return run


def _review_sql(expression: str) -> str:
    return from_stage("reviews", f"SELECT event_id, {expression} AS result FROM reviews")


query("strip_urls", _review_sql(sq.urls("content")))(_per_review(tx.strip_urls))
query("strip_nonprintable", _review_sql(sq.printable("content")))(_per_review(tx.strip_nonprintable))
query("nfkc_normalize", _review_sql("nfc_normalize(content)"))(_per_review(tx.nfkc_normalize))
query("collapse_whitespace", _review_sql(sq.spaces("content")))(_per_review(tx.collapse_whitespace))
query("strip_emoji", _review_sql(sq.emoji("content")))(_per_review(tx.strip_emoji))
query("clean_text", _review_sql(sq.clean("content")))(_per_review(tx.clean_text))


@query("html_unescape", """
SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),
 '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS decoded FROM pages""")
def html_unescape(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.html_unescape(F.col("html")).alias("decoded"))


@query("clean_rows", from_stage("merged", f"""
SELECT review_id, {sq.clean("content")} AS content, score, CAST(coalesce(thumbs_up, 0) AS BIGINT) AS thumbs_up, created_at
FROM merged WHERE content IS NOT NULL AND {_HAS}"""))
def clean_rows_query(spark, sf_dir):
    columns = ["review_id", "content", "score", "thumbs_up", "created_at"]
    return clean_rows(fx.merged(spark, sf_dir)).select(*columns)


@query("clean_reviews", from_stage("cleaned", f"""
SELECT review_id, "user", content, score, thumbs_up, {r6("thumbs_up_capped")}, app_version, created_at, source, content_len,
 is_very_long FROM cleaned"""))
def clean_reviews_query(spark, sf_dir):
    return clean_reviews(fx.merged(spark, sf_dir))


@query("drop_blank_content", from_stage("merged", f"""
SELECT review_id, content, source FROM merged WHERE content IS NOT NULL AND {_HAS}"""))
def drop_blank_content(spark, sf_dir):
    return fl.drop_blank_content(fx.merged(spark, sf_dir)).select("review_id", "content", "source")


@query("drop_empty_after_clean", from_stage("merged", f"""
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count_if({_HAS}) AS BIGINT) AS rows_after,
 CAST(count_if(NOT {_HAS}) AS BIGINT) AS rows_removed, {r6(f'100.0 * count_if(NOT {_HAS}) / count(*)', 'removed_pct')}
FROM (SELECT {sq.clean("content")} AS content FROM merged WHERE content IS NOT NULL AND {_HAS})"""))
def drop_empty_after_clean(spark, sf_dir):
    return fl.blank_content_report(fx.clean_stage(spark, sf_dir).select("content"))


@query("fillna_zero", from_stage("merged", """
SELECT source, created_at, coalesce(thumbs_up, 0) AS thumbs_up FROM merged"""))
def fillna_zero(spark, sf_dir):
    return fl.fill_zero(fx.merged(spark, sf_dir).select("source", "created_at", "thumbs_up"))


@query("complete_cases", from_stage("cleaned", """
SELECT review_id, score, app_version, created_at FROM cleaned
WHERE review_id IS NOT NULL AND score IS NOT NULL AND app_version IS NOT NULL AND created_at IS NOT NULL"""))
def complete_cases(spark, sf_dir):
    return fl.complete_cases(fx.cleaned_short(spark, sf_dir)).select("review_id", "score", "app_version", "created_at")


@query("split_low_high", from_stage("cleaned", """
SELECT CASE WHEN score <= 2 THEN 'low' ELSE 'high' END AS score_group, score, content FROM cleaned
WHERE score <= 2 OR score = 5"""))
def split_low_high(spark, sf_dir):
    return fl.split_low_high(fx.cleaned_once(spark, sf_dir)).select("score_group", "score", "content")


@query("sample_n", from_stage("cleaned", f"""
SELECT row_key, content_len FROM (SELECT {sq.ROW_KEY} AS row_key, content_len FROM cleaned)
ORDER BY substr(md5(concat('42|', row_key)), 1, 13) LIMIT 2000"""))
def sample_n(spark, sf_dir):
    rows = fx.cleaned_facts(spark, sf_dir).select("row_key", "content_len")
    return od.sample_rows(rows, 2000, ["row_key"])


@query("project_final_columns", from_stage("cleaned", f"""
SELECT review_id, "user", content, score, thumbs_up, {r6('thumbs_up_capped')}, created_at, source, content_len
FROM cleaned"""))
def project_final(spark, sf_dir):
    df = fx.cleaned_once(spark, sf_dir).drop("app_version", "is_very_long").withColumn("scratch", F.lit(1))
    return project_final_columns(df.select(*reversed(df.columns)))


@query("clean_examples", from_stage("reviews", f"""
SELECT substr(content, 1, 80) AS before, substr(cleaned, 1, 80) AS after FROM (
 SELECT content, {sq.clean("content")} AS cleaned FROM reviews WHERE content IS NOT NULL)
WHERE content <> cleaned AND length(content) < 100"""))
def clean_examples(spark, sf_dir):
    """On all rows and whole texts; short planted texts are in the tests."""
    rows = fx.raw_reviews(spark, sf_dir).filter(F.col("content").isNotNull())
    pairs = rows.select("event_id", "content").withColumn("cleaned", tx.clean_text(F.col("content")))
    return ql.clean_examples(pairs, "content", "cleaned", ["event_id"], rows=None)


@query("dedup_newest_by_id", from_stage("cleaned", """
SELECT review_id, "user", content, score, thumbs_up, app_version, created_at, source FROM uniq"""))
def dedup_newest_by_id(spark, sf_dir):
    return dd.dedup_newest_by_id(fl.drop_blank_content(fx.clean_stage(spark, sf_dir)))


@query("dedup_newest_by_user_content", from_stage("merged", f"""
SELECT "user", content, created_at, score FROM (SELECT *, row_number() OVER (PARTITION BY "user", content ORDER BY {NEWEST}) AS rn
 FROM merged) WHERE rn = 1"""))
def dedup_newest_by_user_content(spark, sf_dir):
    return dd.dedup_newest_by_user_content(fx.merged(spark, sf_dir)).select("user", "content", "created_at", "score")


@query("dedup_first_by_id", from_stage("reviews", """
SELECT review_id, event_id, score FROM (SELECT *, row_number() OVER (
 PARTITION BY review_id, CASE WHEN review_id IS NULL THEN event_id END ORDER BY event_id) AS rn FROM reviews) WHERE rn = 1"""))
def dedup_first_by_id(spark, sf_dir):
    rows = fx.raw_reviews(spark, sf_dir).select("review_id", "event_id", "score")
    return dd.dedup_first_by_id(rows, [F.col("event_id")])


@query("duplicate_count", from_stage("merged", """
SELECT count(review_id) AS ids, count(DISTINCT review_id) AS unique_ids,
 count(review_id) - count(DISTINCT review_id) AS duplicates FROM merged"""))
def duplicate_count(spark, sf_dir):
    return dd.duplicate_count(fx.merged(spark, sf_dir))


@query("sort_newest_first", from_stage("cleaned", """
SELECT review_id, created_at, score FROM cleaned ORDER BY created_at DESC NULLS LAST, review_id NULLS FIRST"""))
def sort_newest_first(spark, sf_dir):
    rows = fx.cleaned_short(spark, sf_dir).select("review_id", "created_at", "score")
    return od.sort_newest_first(rows, "created_at", "review_id")


@query("head_n", from_stage("cleaned", """
SELECT review_id, created_at, score FROM cleaned ORDER BY created_at DESC NULLS LAST, review_id NULLS FIRST LIMIT 5000"""))
def head_n(spark, sf_dir):
    rows = fx.cleaned_short(spark, sf_dir).select("review_id", "created_at", "score")
    return od.head_rows(rows, 5000, "created_at", ("review_id",))


@query("page_slice", from_stage("cleaned", """
SELECT review_id, created_at, score FROM cleaned ORDER BY created_at DESC NULLS LAST, review_id NULLS FIRST
LIMIT 1500 OFFSET 3000"""))
def page_slice(spark, sf_dir):
    rows = fx.cleaned_short(spark, sf_dir).select("review_id", "created_at", "score")
    return od.page_slice(rows, 3, 1500, "created_at", ("review_id",))


@query("page_index", from_stage("cleaned", """
SELECT review_id, created_at, rn AS row_no, (rn - 1) // 1500 + 1 AS page_no FROM (
 SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, review_id NULLS FIRST) AS rn FROM cleaned)"""))
def page_index(spark, sf_dir):
    rows = fx.cleaned_short(spark, sf_dir).select("review_id", "created_at")
    return od.page_index(rows, od.newest_first("created_at", "review_id"), 1500)


@query("page_ranges", from_stage("cleaned", """
SELECT page_no, CAST(ceil(n / 1500.0) AS BIGINT) AS total_pages, n AS total_rows,
 (page_no - 1) * 1500 + 1 AS first_row, least(page_no * 1500, n) AS last_row
FROM (SELECT count(*) AS n FROM cleaned), range(1, 1000000) p(page_no) WHERE (page_no - 1) * 1500 < n"""))
def page_ranges(spark, sf_dir):
    return od.page_ranges(fx.cleaned_short(spark, sf_dir), 1500)


_MISSING = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count_if({q} IS NULL) AS missing FROM merged"
    for c, q in [
        ("review_id", "review_id"), ("user", '"user"'), ("content", "content"), ("score", "score"),
        ("thumbs_up", "thumbs_up"), ("app_version", "app_version"), ("created_at", "created_at"), ("source", "source"),
    ]
)


@query("missing_summary", from_stage("merged", f"""
SELECT column_name, CAST(missing AS BIGINT) AS missing, {r6('100.0 * missing / total', 'missing_pct')}
FROM ({_MISSING}) WHERE missing > 0"""))
def missing_summary(spark, sf_dir):
    return ql.missing_summary(fx.merged(spark, sf_dir))


@query("missing_total", from_stage("merged", f"SELECT CAST(sum(missing) AS BIGINT) AS missing_total FROM ({_MISSING})"))
def missing_total(spark, sf_dir):
    return ql.missing_total(fx.merged(spark, sf_dir))


@query("missing_for_column", from_stage("merged", f"""
SELECT column_name, CAST(missing AS BIGINT) AS missing, {r6('100.0 * missing / total', 'missing_pct')}
FROM ({_MISSING}) WHERE column_name IN ('score', 'thumbs_up')"""))
def missing_for_column(spark, sf_dir):
    return ql.missing_for_columns(fx.merged(spark, sf_dir), ["score", "thumbs_up"])


def _share_sql(column: str, out: str, extra: str = "") -> str:
    return from_stage("cleaned", f"""
SELECT {column} AS {out}, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM cleaned)', 'pct')}{extra}
FROM cleaned WHERE {column} IS NOT NULL GROUP BY {column}""")


@query("source_distribution", _share_sql("source", "source"))
def source_distribution(spark, sf_dir):
    return ql.source_distribution(fx.cleaned_short(spark, sf_dir))


@query("rating_distribution", _share_sql(
    "score", "score",
    ", repeat('█', CAST(floor(50.0 * count(*) / (SELECT count(*) FROM cleaned)) AS INTEGER)) AS bar"))
def rating_distribution(spark, sf_dir):
    return ql.rating_distribution(fx.cleaned_short(spark, sf_dir))


@query("histogram_bar", _share_sql(
    "source", "source",
    ", repeat('█', CAST(floor(50.0 * count(*) / (SELECT count(*) FROM cleaned)) AS INTEGER)) AS bar"))
def histogram_bar(spark, sf_dir):
    shares = ql.source_distribution(fx.cleaned_short(spark, sf_dir))
    return shares.withColumn("bar", rv.histogram_bar(F.col("pct")))


@query("yearly_distribution", _share_sql("CAST(year(created_at) AS INTEGER)", "year"))
def yearly_distribution(spark, sf_dir):
    return ql.yearly_distribution(fx.cleaned_short(spark, sf_dir))


@query("rating_stats", from_stage("cleaned", f"""
SELECT {r6('avg(score)', 'mean')}, {r6('median(score)', 'median')},
 (SELECT score FROM cleaned WHERE score IS NOT NULL GROUP BY score ORDER BY count(*) DESC, score LIMIT 1) AS mode,
 {r6('stddev_samp(score)', 'std')} FROM cleaned"""))
def rating_stats(spark, sf_dir):
    return ql.rating_stats(fx.cleaned_short(spark, sf_dir))


@query("length_stats", from_stage("cleaned", f"""
SELECT CAST(min(content_len) AS INTEGER) AS min_len, {r6('avg(content_len)', 'mean_len')},
 {r6('median(content_len)', 'median_len')}, CAST(max(content_len) AS INTEGER) AS max_len,
 {r6('stddev_samp(content_len)', 'std_len')} FROM cleaned"""))
def length_stats(spark, sf_dir):
    return ql.length_stats(fx.cleaned_short(spark, sf_dir))


@query("thumbs_quantiles", from_stage("cleaned", "SELECT " + ", ".join(
    r6(f"quantile_cont(CAST(thumbs_up AS DOUBLE), {p / 100})", f"p{p}") for p in (25, 50, 75, 95, 99)) + " FROM cleaned"))
def thumbs_quantiles(spark, sf_dir):
    return ql.thumbs_quantiles(fx.cleaned_short(spark, sf_dir))


@query("value_quantiles", "SELECT " + ", ".join(
    r6(f"quantile_cont(l_extendedprice, {p})", n) for n, p in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99), ("q999", 0.999)))
    + " FROM lineitem")
def value_quantiles(spark, sf_dir):
    probs = {"q01": 0.01, "q50": 0.5, "q99": 0.99, "q999": 0.999}
    return ql.quantile_row(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", probs)


@query("cap_at_quantile", """
SELECT event_id, round(least(value, (SELECT quantile_cont(value, 0.99) FROM events)), 6) AS capped FROM events""")
def cap_at_quantile(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "value")
    return ql.cap_at_quantile(events, "value", "capped").drop("value")


@query("scalar_broadcast", f"""
SELECT event_id, {r6('value - (SELECT avg(value) FROM events)', 'centred')} FROM events""")
def scalar_broadcast(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    mean = events.agg(F.avg("value")).scalar()
    return events.select("event_id", (F.col("value") - mean).alias("centred"))


@query("flag_very_long", """
SELECT doc_id, length(text) > (SELECT quantile_cont(CAST(length(text) AS DOUBLE), 0.999) FROM documents) AS is_very_long
FROM documents""")
def flag_very_long(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("content_len"))
    return ql.flag_very_long(docs).drop("content_len")


@query("flag_very_short", from_stage("merged", f"""
SELECT CAST(count_if(length(content) < 10) AS BIGINT) AS very_short,
 {r6('100.0 * count_if(length(content) < 10) / count(*)', 'very_short_pct')} FROM merged"""))
def flag_very_short(spark, sf_dir):
    return ql.very_short_share(fx.merged(spark, sf_dir))


@query("outlier_count", from_stage("cleaned", f"""
SELECT {r6('max(p99)', 'threshold')}, CAST(count_if(thumbs_up > p99) AS BIGINT) AS outliers,
 {r6('100.0 * count_if(thumbs_up > p99) / count(*)', 'outlier_pct')} FROM uniq, limits"""))
def outlier_count(spark, sf_dir):
    return ql.outlier_count(fx.cleaned_short(spark, sf_dir))


@query("column_range_stats", from_stage("cleaned", f"""
SELECT 'score' AS column_name, min(score) AS min_value, max(score) AS max_value, {r6('avg(score)', 'mean_value')} FROM cleaned
UNION ALL SELECT 'thumbs_up', CAST(min(thumbs_up) AS DOUBLE), CAST(max(thumbs_up) AS DOUBLE), round(avg(thumbs_up), 6) FROM cleaned"""))
def column_range_stats(spark, sf_dir):
    return ql.column_range_stats(fx.cleaned_short(spark, sf_dir), ["score", "thumbs_up"])


@query("date_coverage", from_stage("cleaned", f"""
SELECT count(created_at) AS valid_dates, {r6('100.0 * count(created_at) / count(*)', 'valid_pct')},
 min(created_at) AS first_date, max(created_at) AS last_date, date_sub('day', min(created_at), max(created_at)) AS span_days
FROM cleaned"""))
def date_coverage(spark, sf_dir):
    return ql.date_coverage(fx.cleaned_short(spark, sf_dir))


_NULLS = lambda t, cols: (
    "SELECT count(*) AS n, CAST(sum(" + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols) + f") AS BIGINT) AS nulls FROM {t}"
)
_EIGHT = ["review_id", '"user"', "content", "score", "thumbs_up", "app_version", "created_at", "source"]


@query("quality_delta", from_stage("cleaned", f"""
SELECT 'rows' AS metric, b.n AS before, a.n AS after, {r6('100.0 * (a.n - b.n) / b.n', 'change_pct')} FROM b0 b, a0 a
UNION ALL SELECT 'missing', b.nulls, a.nulls, round(100.0 * (a.nulls - b.nulls) / greatest(b.nulls, 1), 6) FROM b0 b, a0 a
UNION ALL SELECT 'duplicates', (SELECT count(review_id) - count(DISTINCT review_id) FROM clean_rows), 0, -100.0""",
    f"b0 AS ({_NULLS('merged', _EIGHT)})", f"a0 AS ({_NULLS('cleaned', [*_EIGHT, 'thumbs_up_capped', 'content_len', 'is_very_long'])})"))
def quality_delta(spark, sf_dir):
    merged = fx.merged(spark, sf_dir)
    duplicates = dd.duplicate_count(fl.drop_blank_content(fx.clean_stage(spark, sf_dir)))
    return ql.quality_delta(merged, fx.cleaned(spark, sf_dir), duplicates)

