"""Queries: monthly trends, releases, keywords and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.constants import EMOTIONAL_KEYWORDS, FUNCTIONAL_KEYWORDS
from reviewmill.functions import reviews as rv
from reviewmill.functions.automaton import find_keywords
from reviewmill.operators import keywords as kw
from reviewmill.operators import ordering as od
from reviewmill.operators import trends as tr
from reviewmill.plans import fixtures as fx
from reviewmill.plans.registry import query
from reviewmill.plans.sql import from_stage, r6

_MAJOR = (
    "TRY_CAST(coalesce(nullif(regexp_extract(app_version, '(?i)\\bv?(\\d+)(?:\\.\\d+)?', 1), ''), "
    "nullif(regexp_extract(app_version, '(\\d+)', 1), '')) AS BIGINT)"
)
_INPUT = f"""
trend AS (
 SELECT score, created_at, CAST(last_day(created_at) AS TIMESTAMP) AS year_month, {_MAJOR} AS major_version,
  CASE WHEN score <= 2 THEN 'Negative' WHEN score = 3 THEN 'Neutral' ELSE 'Positive' END AS sentiment
 FROM cleaned WHERE score IS NOT NULL AND created_at IS NOT NULL
),
first_seen AS (
 SELECT major_version, min(created_at) AS first_seen, CAST(last_day(min(created_at)) AS TIMESTAMP) AS first_seen_month
 FROM trend WHERE major_version IS NOT NULL GROUP BY 1
),
releases AS (
 SELECT first_seen_month, string_agg(concat('v', major_version), ', ' ORDER BY major_version) AS versions_list,
  string_agg(CAST(major_version AS VARCHAR), ',' ORDER BY major_version) AS versions
 FROM first_seen GROUP BY 1
),
mix AS (
 SELECT year_month, count(*) AS total_count, count_if(sentiment = 'Negative') AS neg,
  count_if(sentiment = 'Neutral') AS neu, count_if(sentiment = 'Positive') AS pos FROM trend GROUP BY 1
),
dense AS (
 SELECT year_month, 'Negative' AS sentiment, CAST(neg AS BIGINT) AS n FROM mix
 UNION ALL SELECT year_month, 'Neutral', CAST(neu AS BIGINT) FROM mix
 UNION ALL SELECT year_month, 'Positive', CAST(pos AS BIGINT) FROM mix
)"""


def _trend(select: str) -> str:
    return from_stage("cleaned", select, _INPUT)


_MONTHLY = _trend(f"SELECT year_month, {r6('avg(score)', 'mean_score')} FROM trend GROUP BY 1")
_TREND = _trend(f"""
SELECT year_month, {r6('CAST(neg AS DOUBLE) / total_count', '"Negative"')},
 {r6('CAST(neu AS DOUBLE) / total_count', '"Neutral"')}, {r6('CAST(pos AS DOUBLE) / total_count', '"Positive"')},
 total_count, coalesce(versions_list, '—') AS versions_list
FROM mix LEFT JOIN releases ON first_seen_month = year_month""")


@query("monthly_mean_rating", _MONTHLY)
@query("chart_monthly_rating", _MONTHLY)
def monthly_mean_rating(spark, sf_dir):
    return tr.monthly_mean_rating(fx.cleaned_short(spark, sf_dir))


@query("sentiment_trend", _TREND)
@query("chart_sentiment_area", _TREND)
def sentiment_trend(spark, sf_dir):
    return tr.sentiment_trend(fx.cleaned_short(spark, sf_dir))


@query("sentiment_monthly_counts", _trend("SELECT year_month, sentiment, count(*) AS n FROM trend GROUP BY 1, 2"))
def sentiment_monthly_counts(spark, sf_dir):
    return tr.sentiment_counts(fx.cleaned_short(spark, sf_dir))


@query("densify_cross_join", _trend("SELECT * FROM dense"))
def densify_cross_join(spark, sf_dir):
    return tr.densify(fx.cleaned_short(spark, sf_dir))


@query("share_within_month", _trend(f"""
SELECT year_month, sentiment, n, {r6('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY year_month)', 'prop')} FROM dense"""))
def share_within_month(spark, sf_dir):
    return tr.share_within_month(tr.densify(fx.cleaned_short(spark, sf_dir)))


@query("pivot_sentiment", _trend(f"""
SELECT year_month, {r6('CAST(neg AS DOUBLE) / total_count', '"Negative"')},
 {r6('CAST(neu AS DOUBLE) / total_count', '"Neutral"')}, {r6('CAST(pos AS DOUBLE) / total_count', '"Positive"')} FROM mix"""))
def pivot_sentiment(spark, sf_dir):
    return tr.pivot_sentiment(fx.cleaned_short(spark, sf_dir))


@query("version_first_seen", _trend("SELECT major_version, first_seen, first_seen_month FROM first_seen"))
def version_first_seen(spark, sf_dir):
    return tr.version_first_seen(fx.cleaned_short(spark, sf_dir))


@query("first_seen_top20", _trend("""
SELECT major_version, first_seen, first_seen_month FROM first_seen ORDER BY first_seen, major_version LIMIT 20"""))
def first_seen_top20(spark, sf_dir):
    return tr.first_seen_sample(fx.cleaned_short(spark, sf_dir))


@query("versions_by_month", _trend("SELECT first_seen_month, versions FROM releases"))
def versions_by_month(spark, sf_dir):
    grouped = tr.versions_by_month(fx.cleaned_short(spark, sf_dir))
    return grouped.select("first_seen_month", F.concat_ws(",", F.col("versions").cast("array<string>")).alias("versions"))


@query("versions_label", _trend("SELECT first_seen_month, versions_list FROM releases"))
def versions_label(spark, sf_dir):
    grouped = tr.versions_by_month(fx.cleaned_short(spark, sf_dir))
    return grouped.select("first_seen_month", rv.versions_label(F.col("versions")).alias("versions_list"))


@query("month_version_join", _trend("""
SELECT DISTINCT year_month, coalesce(versions_list, '—') AS versions_list FROM trend
LEFT JOIN releases ON first_seen_month = year_month"""))
def month_version_join(spark, sf_dir):
    df = fx.cleaned_short(spark, sf_dir)
    return tr.with_versions(tr.month_mix(df).select("year_month"), df)


@query("month_total_join", _trend("SELECT year_month, total_count FROM mix"))
def month_total_join(spark, sf_dir):
    return tr.sentiment_trend(fx.cleaned_short(spark, sf_dir)).select("year_month", "total_count")


@query("release_marker_thinning", _trend("""
SELECT first_seen_month, n <= 3 OR i % 2 = 1 AS labelled FROM (
 SELECT first_seen_month, row_number() OVER (ORDER BY first_seen_month) AS i, count(*) OVER () AS n FROM releases)"""))
def release_marker_thinning(spark, sf_dir):
    return od.release_markers(tr.version_first_seen(fx.cleaned_short(spark, sf_dir)), limit=3)


@query("month_coverage", _trend("""
SELECT count(*) AS months, min(year_month) AS first_month, max(year_month) AS last_month,
 (SELECT count(*) FROM releases) AS release_months FROM mix"""))
def month_coverage(spark, sf_dir):
    return tr.month_coverage(fx.cleaned_short(spark, sf_dir))


@query("month_bucket", "SELECT event_id, CAST(last_day(ts) AS TIMESTAMP) AS month_end FROM events")
def month_bucket(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", rv.month_end(F.col("ts")).alias("month_end"))


@query("major_version", from_stage("reviews", f"SELECT event_id, {_MAJOR} AS major_version FROM reviews"))
def major_version(spark, sf_dir):
    return fx.raw_reviews(spark, sf_dir).select("event_id", rv.major_version(F.col("app_version")).alias("major_version"))


def _pattern(words: list[str]) -> str:
    return "(" + "|".join(sorted(words, key=lambda word: (-len(word), word))) + ")"


def _hits(words: list[str]) -> str:
    return f"list_distinct(regexp_extract_all(lower(content), '{_pattern(words)}'))"


_ANNOTATED = f"""
annotated AS (
 SELECT review_id, CASE WHEN score <= 2 THEN 'low' ELSE 'high' END AS score_group,
  {_hits(EMOTIONAL_KEYWORDS)} AS em, {_hits(FUNCTIONAL_KEYWORDS)} AS fn FROM cleaned WHERE score <= 2 OR score = 5
),
kw_stats AS (
 SELECT score_group, count(*) AS n, CAST(count_if(len(em) > 0) AS BIGINT) AS em_count,
  CAST(count_if(len(fn) > 0) AS BIGINT) AS fn_count FROM annotated GROUP BY 1
),
bars AS (
 SELECT score_group, 'Emotional' AS category, round(100.0 * em_count / n, 2) AS prop_pct FROM kw_stats
 UNION ALL SELECT score_group, 'Functional', round(100.0 * fn_count / n, 2) FROM kw_stats
),
freq AS (
 SELECT score_group, category, keyword, count(*) AS n FROM (
  SELECT score_group, 'Emotional' AS category, unnest(em) AS keyword FROM annotated
  UNION ALL SELECT score_group, 'Functional', unnest(fn) FROM annotated) GROUP BY 1, 2, 3
),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY score_group, category ORDER BY n DESC, keyword) AS rank FROM freq
)"""


def _kw(select: str) -> str:
    return from_stage("cleaned", select, _ANNOTATED)


@query("extract_keywords", from_stage("reviews", f"""
SELECT event_id, coalesce(array_to_string(list_sort({_hits(EMOTIONAL_KEYWORDS)}), ','), '') AS em_matches,
 coalesce(array_to_string(list_sort({_hits(FUNCTIONAL_KEYWORDS)}), ','), '') AS fn_matches FROM reviews"""))
def extract_keywords(spark, sf_dir):
    lists = {"em_matches": EMOTIONAL_KEYWORDS, "fn_matches": FUNCTIONAL_KEYWORDS}
    hits = fx.raw_reviews(spark, sf_dir).select("event_id", find_keywords(F.col("content"), lists).alias("hits"))
    joined = [F.array_join(F.array_sort(f"hits.{name}"), ",").alias(name) for name in lists]
    return hits.select("event_id", *joined)


@query("has_keyword", _kw("SELECT review_id, score_group, len(em) > 0 AS has_em, len(fn) > 0 AS has_fn FROM annotated"))
def has_keyword(spark, sf_dir):
    return kw.annotate_keywords(fx.cleaned_once(spark, sf_dir)).select("review_id", "score_group", "has_em", "has_fn")


@query("keyword_group_stats", _kw(f"""
SELECT score_group, n, em_count, fn_count, {r6('CAST(em_count AS DOUBLE) / n', 'em_prop')},
 {r6('CAST(fn_count AS DOUBLE) / n', 'fn_prop')} FROM kw_stats"""))
def keyword_group_stats(spark, sf_dir):
    return kw.keyword_group_stats(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir))


@query("chart_keyword_proportion", _kw("SELECT score_group, category, prop_pct FROM bars"))
def chart_keyword_proportion(spark, sf_dir):
    return kw.keyword_proportions(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir))


@query("keyword_document_frequency", _kw("SELECT score_group, category, keyword, n FROM freq"))
def keyword_document_frequency(spark, sf_dir):
    return kw.keyword_document_frequency(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir))


@query("top_keywords", _kw("SELECT score_group, category, keyword, n, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 15"))
def top_keywords(spark, sf_dir):
    return kw.top_keywords(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir))


@query("keyword_summary_table", _kw("""
SELECT score_group, category, coalesce(words, '') AS top_keywords, prop_pct FROM bars LEFT JOIN (
 SELECT score_group, category, string_agg(keyword, ', ' ORDER BY rank) AS words FROM ranked WHERE rank <= 5 GROUP BY 1, 2)
USING (score_group, category)"""))
def keyword_summary_table(spark, sf_dir):
    return kw.keyword_summary(fx.cleaned_short(spark, sf_dir), counts=fx.keyword_table(spark, sf_dir))


KEYWORD_FILES_SQL = _kw("SELECT score_group, category, keyword, n FROM ranked WHERE rank <= 15")
