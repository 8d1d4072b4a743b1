"""SQL twins of the stages, as common table expressions for the value checks."""

from __future__ import annotations

REVIEWS = """
reviews AS (
 SELECT
  CASE WHEN e.event_id % 97 = 0 THEN NULL
       ELSE concat('r', CAST(e.event_id - CASE WHEN e.event_id % 20 = 1 THEN 1 ELSE 0 END AS VARCHAR)) END AS review_id,
  CASE WHEN e.event_id % 13 = 0 THEN 'Google User' WHEN e.event_id % 17 = 0 THEN NULL
       ELSE concat('u', CAST(e.user_id AS VARCHAR)) END AS "user",
  CASE WHEN e.event_id % 101 = 0 THEN NULL WHEN e.event_id % 103 = 0 THEN '   '
       ELSE concat(d.text, CASE e.event_type
            WHEN 'error' THEN ' app crash &amp; bug http://x.io/a' WHEN 'purchase' THEN ' Great VIDEO filter 😀'
            WHEN 'view' THEN ' Broken UI!!' ELSE '' END) END AS content,
  CAST(CASE WHEN e.event_id % 89 = 0 THEN NULL WHEN e.event_id % 10 < 3 THEN 1 WHEN e.event_id % 10 = 3 THEN 2
       WHEN e.event_id % 10 = 4 THEN 3 WHEN e.event_id % 10 = 5 THEN 4 ELSE 5 END AS DOUBLE) AS score,
  CASE WHEN e.event_id % 53 = 0 THEN NULL ELSE CAST(floor(e.value) AS BIGINT) END AS thumbs_up,
  CASE WHEN e.event_id % 31 = 0 THEN NULL
       ELSE concat('v', CAST(30 + e.event_id % 12 AS VARCHAR), '.1.', CAST(e.event_id % 5 AS VARCHAR)) END AS app_version,
  CASE WHEN e.event_id % 211 = 0 THEN NULL ELSE e.ts + INTERVAL '30' DAY * CAST(e.event_id % 12 AS INT) END AS created_at,
  CASE WHEN e.event_id % 5 < 2 THEN 'google_play' ELSE 'kaggle' END AS source,
  e.event_id
 FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) c
 LEFT JOIN documents d ON d.doc_id = e.event_id % c.n
)"""

_BAD_USER = """("user" IS NULL OR lower(trim("user")) IN ('google user', 'nan', 'none', ''))"""

MERGED = f"""
merged AS (
 SELECT review_id,
  CASE WHEN bad AND review_id IS NOT NULL THEN concat('anon_', review_id)
       WHEN bad THEN concat('anon_idx_', CAST(idx AS VARCHAR)) ELSE "user" END AS "user",
  content, score, CAST(thumbs_up AS DOUBLE) AS thumbs_up, app_version, created_at, source
 FROM (SELECT *, row_number() OVER (PARTITION BY bad AND review_id IS NULL
          ORDER BY source, created_at NULLS FIRST, content NULLS FIRST) - 1 AS idx
       FROM (SELECT *, {_BAD_USER} AS bad FROM reviews))
)"""

HAS_TEXT = r"regexp_matches({0}, '\S')"
_UNESCAPE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_URLS = r"regexp_replace({0}, 'http\S+|www\.\S+', '', 'g')"
_PRINTABLE = r"regexp_replace({0}, '[\x{{0}}-\x{{8}}\x{{B}}-\x{{1F}}\x{{7F}}-\x{{A0}}\x{{AD}}]', '', 'g')"
_SPACES = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_EMOJI = (
    r"regexp_replace({0}, '[\x{{1F600}}-\x{{1F64F}}\x{{1F300}}-\x{{1F5FF}}\x{{1F680}}-\x{{1F6FF}}"
    r"\x{{1F1E0}}-\x{{1F1FF}}\x{{2702}}-\x{{27B0}}\x{{24C2}}-\x{{1F251}}]+', '', 'g')"
)


def unescape(c: str) -> str:
    return _UNESCAPE.format(c)


def urls(c: str) -> str:
    return _URLS.format(c)


def printable(c: str) -> str:
    return _PRINTABLE.format(c)


def spaces(c: str) -> str:
    return _SPACES.format(c)


def emoji(c: str) -> str:
    return _EMOJI.format(c)


def clean(c: str) -> str:
    return emoji(spaces(printable(urls(unescape(c)))))


NEWEST = (
    'created_at DESC NULLS LAST, content NULLS FIRST, "user" NULLS FIRST, app_version NULLS FIRST, '
    "source NULLS FIRST, score NULLS FIRST, thumbs_up NULLS FIRST"
)

#: rows without id are told apart by user and text
ONE_ID = 'review_id, CASE WHEN review_id IS NULL THEN "user" END, CASE WHEN review_id IS NULL THEN content END'
ROW_KEY = """coalesce(review_id, concat('key-', md5(concat(coalesce("user", ''), '|', coalesce(content, '')))))"""

CLEAN_ROWS = f"""
clean_rows AS (
 SELECT * FROM (
  SELECT review_id, "user", {clean("content")} AS content, score,
   CAST(coalesce(thumbs_up, 0) AS BIGINT) AS thumbs_up, app_version, created_at, source
  FROM merged WHERE content IS NOT NULL AND {HAS_TEXT.format("content")})
 WHERE {HAS_TEXT.format("content")}
)"""

CLEANED = f"""
uniq AS (
 SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {ONE_ID} ORDER BY {NEWEST}) AS rn FROM clean_rows) WHERE rn = 1
),
limits AS (
 SELECT quantile_cont(CAST(thumbs_up AS DOUBLE), 0.99) AS p99,
        quantile_cont(CAST(length(content) AS DOUBLE), 0.999) AS p999 FROM uniq
),
cleaned AS (
 SELECT review_id, "user", content, score, thumbs_up, least(CAST(thumbs_up AS DOUBLE), p99) AS thumbs_up_capped,
  app_version, created_at, source, CAST(length(content) AS INTEGER) AS content_len,
  length(content) > p999 AS is_very_long
 FROM uniq, limits
)"""

FEATURES = r"""
measured AS (
 SELECT *,
  CAST(length(content) AS BIGINT) AS content_len_chars,
  CAST(len(regexp_extract_all(content, '\S+')) AS BIGINT) AS content_len_words,
  CAST(length(content) - length(regexp_replace(content, '[!?.,;:]', '', 'g')) AS INTEGER) AS punct_count,
  length(regexp_replace(content, '[^\p{Lu}]', '', 'g')) / greatest(length(content), 1) AS upper_ratio,
  length(regexp_replace(content, '\s+', '', 'g')) AS letters,
  CAST(trunc(thumbs_up_capped) AS BIGINT) AS thumbs_up_feat,
  CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
  CAST(isodow(created_at) - 1 AS INTEGER) AS day_of_week,
  date_sub('day', (SELECT min(created_at) FROM cleaned), created_at) AS days_since_first,
  CASE WHEN score IS NULL THEN NULL WHEN score <= 2 THEN 'negative' WHEN score = 3 THEN 'neutral' ELSE 'positive' END
    AS sentiment_coarse
 FROM cleaned
),
features AS (
 SELECT * EXCLUDE (letters),
  CASE WHEN content_len_words > 0 THEN letters / content_len_words ELSE 0.0 END AS avg_word_len,
  ln(1 + thumbs_up_feat) AS log_thumbs_up,
  CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
  least(content_len_words / (punct_count + 1), 100.0) AS words_per_punct,
  least(thumbs_up_feat / (content_len_words + 1), 10.0) AS engagement_per_word
 FROM measured
)"""

BASE = [
    "content_len_chars", "content_len_words", "avg_word_len", "punct_count", "upper_ratio",
    "thumbs_up_feat", "log_thumbs_up", "words_per_punct", "engagement_per_word",
]
TEMPORAL = ["year", "month", "day_of_week", "days_since_first"]
MATRIX = BASE + TEMPORAL


def share_out(counts: str, part: str, n: str, draws: str) -> str:
    """Largest-remainder allocation of ``draws`` over rows (sentiment_coarse, ``n``) of ``counts``."""
    return f"""
{part} AS (
 SELECT sentiment_coarse, CAST(base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END AS BIGINT) AS n FROM (
  SELECT sentiment_coarse, base, d - sum(base) OVER () AS left_over,
   row_number() OVER (ORDER BY exact - base DESC, sentiment_coarse) AS rk FROM (
    SELECT sentiment_coarse, d, CAST({n} AS DOUBLE) * d / t AS exact, floor(CAST({n} AS DOUBLE) * d / t) AS base
    FROM (SELECT *, sum({n}) OVER () AS t, {draws} AS d FROM {counts})))
)"""


SPLIT = (
    f"""
model_rows AS (
 SELECT *, substr(md5(concat('42|', row_key)), 1, 13) AS h
 FROM (SELECT *, {ROW_KEY} AS row_key FROM features) WHERE sentiment_coarse IS NOT NULL
),
label_n AS (SELECT sentiment_coarse, count(*) AS n FROM model_rows GROUP BY 1),
"""
    + share_out(
        "label_n", "rest_n", "n", "sum(n) OVER () - CAST(ceil(CAST(0.15 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)"
    )
    + ","
    + share_out(
        "rest_n", "train_n", "n", "sum(n) OVER () - CAST(ceil(CAST(0.176 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)"
    )
    + """,
split AS (
 SELECT m.* EXCLUDE (h, rk),
  CASE WHEN rk <= a.n - r.n THEN 'test' WHEN rk <= a.n - t.n THEN 'val' ELSE 'train' END AS dataset
 FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_coarse ORDER BY h) AS rk FROM model_rows) m
 JOIN label_n a USING (sentiment_coarse) JOIN rest_n r USING (sentiment_coarse) JOIN train_n t USING (sentiment_coarse)
)"""
)

_CHAIN = ["reviews", "merged", "clean_rows", "cleaned", "features", "split"]
_TEXT = dict(zip(_CHAIN, [REVIEWS, MERGED, CLEAN_ROWS, CLEANED, FEATURES, SPLIT]))


def from_stage(stage: str, select: str, *extra: str, recursive: bool = False) -> str:
    """``select`` on top of all stages up to ``stage``; ``extra`` adds more table expressions, which may be ``recursive``."""
    parts = [_TEXT[name] for name in _CHAIN[: _CHAIN.index(stage) + 1]]
    return f"WITH {'RECURSIVE ' * recursive}" + ",".join([*parts, *extra]) + "\n" + select


def r6(expression: str, alias: str | None = None) -> str:
    return f"round({expression}, 6) AS {alias or expression}"
