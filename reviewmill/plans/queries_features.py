"""Queries: scalar features, distributions, encoders, splits, scaling and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import reviews as rv
from reviewmill.functions import text as tx
from reviewmill.functions.casts import to_number
from reviewmill.operators import encoding as en
from reviewmill.operators import features as ft
from reviewmill.operators import scaling as sc
from reviewmill.operators import selection as sl
from reviewmill.operators import splits as sp
from reviewmill.operators.lookup import lookup_join
from reviewmill.plans import fixtures as fx
from reviewmill.plans.modeling import prepare_model_data, stage_summary, training_part
from reviewmill.plans.registry import query
from reviewmill.plans.sql import MATRIX, from_stage, r6
from reviewmill.session import stage_path
from reviewmill.sources import readers, writers

_DOUBLES = ("avg_word_len", "upper_ratio", "log_thumbs_up", "words_per_punct", "engagement_per_word")


def _value(name: str) -> str:
    return r6(name) if name in _DOUBLES else name


# --- scalar features, on whole documents -------------------------------------
_DOC_WORDS = "CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT)"
_SCALARS = {
    "content_len": (lambda c: tx.content_len(c).cast("bigint"), "length(text)"),
    "word_count": (lambda c: tx.word_count(c).cast("bigint"), _DOC_WORDS),
    "avg_word_len": (
        tx.avg_word_len,
        f"round(coalesce(length(regexp_replace(text, '\\s+', '', 'g')) / nullif({_DOC_WORDS}, 0), 0.0), 6)",
    ),
    "punct_count": (
        lambda c: tx.punct_count(c).cast("bigint"),
        "CAST(length(text) - length(regexp_replace(text, '[!?.,;:]', '', 'g')) AS BIGINT)",
    ),
    "upper_ratio": (
        tx.upper_ratio,
        "round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / greatest(length(text), 1), 6)",
    ),
}


def _on_documents(fn):
    def run(spark, sf_dir):
        return fx.table(spark, sf_dir, "documents").select("doc_id", fn(F.col("text")).alias("result"))

    return run


for _name, (_fn, _sql) in _SCALARS.items():
    query(_name, f"SELECT doc_id, {_sql} AS result FROM documents")(_on_documents(_fn))


@query("thumbs_up_feat", from_stage("cleaned", """
SELECT review_id, CAST(trunc(thumbs_up_capped) AS BIGINT) AS thumbs_up_feat FROM cleaned"""))
def thumbs_up_feat(spark, sf_dir):
    df = fx.cleaned_short(spark, sf_dir)
    return df.select("review_id", ft.votes_feature(df).alias("thumbs_up_feat"))


@query("log_thumbs_up", from_stage("cleaned", f"SELECT review_id, {r6('ln(1 + thumbs_up)', 'log_votes')} FROM cleaned"))
def log_thumbs_up(spark, sf_dir):
    return fx.cleaned_short(spark, sf_dir).select("review_id", F.log1p("thumbs_up").alias("log_votes"))


@query("date_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
 CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events""")
def date_parts(spark, sf_dir):
    ts = F.col("ts")
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.year(ts).alias("year"), F.month(ts).alias("month"), rv.day_of_week(ts).alias("day_of_week")
    )


@query("is_weekend", from_stage("cleaned", f"""
SELECT CAST(count_if(isodow(created_at) >= 6) AS BIGINT) AS weekend_reviews,
 {r6('avg(CAST(isodow(created_at) >= 6 AS INTEGER))', 'weekend_share')} FROM cleaned"""))
def is_weekend(spark, sf_dir):
    weekend = fx.features(spark, sf_dir).select("is_weekend")
    return weekend.agg(
        F.count_if(F.col("is_weekend") == 1).alias("weekend_reviews"), F.avg("is_weekend").alias("weekend_share")
    )


@query("days_since_first", """
SELECT l_orderkey, l_linenumber, date_sub('day', (SELECT min(l_shipdate) FROM lineitem), l_shipdate) AS days
FROM lineitem""")
def days_since_first(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem")
    first = items.agg(F.min("l_shipdate")).scalar()
    return items.select("l_orderkey", "l_linenumber", rv.whole_days(first, F.col("l_shipdate")).alias("days"))


@query("label_sentiment", from_stage("reviews", """
SELECT event_id, CASE WHEN score IS NULL THEN NULL WHEN score <= 2 THEN 'negative' WHEN score = 3 THEN 'neutral'
 ELSE 'positive' END AS sentiment FROM reviews"""))
def label_sentiment(spark, sf_dir):
    return fx.raw_reviews(spark, sf_dir).select("event_id", rv.label_sentiment(F.col("score")).alias("sentiment"))


def _feature_query(name: str) -> None:
    def run(spark, sf_dir):
        return fx.features(spark, sf_dir).select("review_id", name)

    query(name, from_stage("features", f"SELECT review_id, {_value(name)} FROM features"))(run)


for _name in ("words_per_punct", "engagement_per_word"):
    _feature_query(_name)


@query("engineer_features", from_stage("features", f"""
SELECT review_id, {', '.join(_value(c) for c in MATRIX)}, is_weekend, sentiment_coarse FROM features"""))
def engineer_features(spark, sf_dir):
    built = ft.engineer_features(fx.cleaned_facts(spark, sf_dir), texts=fx.kept_texts(spark, sf_dir))
    return built.select("review_id", *MATRIX, "is_weekend", "sentiment_coarse")


@query("numeric_feature_list", from_stage("features", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_values FROM features" for c in MATRIX)))
def numeric_feature_list(spark, sf_dir):
    """The features of the matrix, with the number of values each one has."""
    df = fx.features(spark, sf_dir)
    counts = [F.struct(F.lit(n).alias("feature"), F.count(n).alias("n_values")) for n in ft.feature_list(df)]
    return df.agg(F.array(*counts).alias("f")).select(F.inline("f"))


# --- distributions -------------------------------------------------------------
_STATS = "stats AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, median(CAST({c} AS DOUBLE)) AS median, stddev_samp({c}) AS std, "
    f"coalesce(skewness({c}), 0.0) AS skewness, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM features"
    for c in MATRIX
) + ")"
_SHAPES = """CASE WHEN abs(skewness) < 0.5 THEN 'fairly symmetrical' WHEN abs(skewness) < 1 THEN 'moderately skewed'
 ELSE 'highly skewed' END AS shape, CASE WHEN abs(skewness) < 1 THEN 'standard' ELSE 'minmax' END AS scaler"""


@query("feature_distribution_stats", from_stage("features", f"""
SELECT feature, {', '.join(r6(c) for c in ('mean', 'median', 'std', 'skewness', 'min', 'max'))} FROM stats""", _STATS))
def feature_distribution_stats(spark, sf_dir):
    return ft.distribution_stats(fx.features(spark, sf_dir))


@query("skew_interpretation", from_stage("features", f"SELECT feature, {r6('skewness')}, {_SHAPES} FROM stats", _STATS))
def skew_interpretation(spark, sf_dir):
    return ft.skew_interpretation(ft.distribution_stats(fx.features(spark, sf_dir)))


@query("choose_scaler", from_stage("features", f"""
SELECT {r6('median(abs(skewness))', 'median_abs_skew')}, {r6('avg(abs(skewness))', 'mean_abs_skew')},
 CASE WHEN median(abs(skewness)) < 1 THEN 'standard' ELSE 'minmax' END AS scaler FROM stats""", _STATS))
def choose_scaler(spark, sf_dir):
    return ft.scaler_choice(ft.distribution_stats(fx.features(spark, sf_dir))).drop("reason")


@query("cardinality", """
SELECT 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) AS n_distinct, 'one_hot' AS encoder FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'one_hot' FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), CASE WHEN count(DISTINCT l_suppkey) <= 20 THEN 'one_hot' ELSE 'frequency' END
FROM lineitem""")
def cardinality(spark, sf_dir):
    return en.cardinality(fx.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query("class_distribution", from_stage("features", f"""
SELECT sentiment_coarse, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM features)', 'pct')},
 100.0 * count(*) / (SELECT count(*) FROM features) < 10 AS is_minority
FROM features WHERE sentiment_coarse IS NOT NULL GROUP BY 1"""))
def class_distribution(spark, sf_dir):
    return ft.class_distribution(fx.features(spark, sf_dir))


@query("feature_means", from_stage("features", f"""
SELECT {r6('avg(content_len_chars)', 'mean_chars')}, {r6('median(content_len_chars)', 'median_chars')},
 {r6('avg(content_len_words)', 'mean_words')}, {r6('avg(avg_word_len)', 'mean_word_len')},
 {r6('avg(upper_ratio)', 'mean_upper_ratio')}, {r6('avg(thumbs_up_feat)', 'mean_votes')},
 {r6('median(thumbs_up_feat)', 'median_votes')}, CAST(count_if(is_weekend = 1) AS BIGINT) AS weekend_reviews,
 {r6('avg(is_weekend)', 'weekend_share')}, {r6('avg(words_per_punct)', 'mean_words_per_punct')},
 {r6('avg(engagement_per_word)', 'mean_engagement')} FROM features"""))
def feature_means(spark, sf_dir):
    return ft.feature_means(fx.features(spark, sf_dir))


# --- encoders ------------------------------------------------------------------
@query("one_hot_encode", from_stage("features", """
SELECT review_id, CAST(source = 'kaggle' AS DOUBLE) AS source_kaggle, """ + ", ".join(
    f"CAST(coalesce(CAST(month AS VARCHAR), 'missing') = '{m}' AS DOUBLE) AS \"month_{m}\""
    for m in [*range(1, 13), "missing"]) + " FROM features"))
def one_hot_encode(spark, sf_dir):
    df = fx.features(spark, sf_dir)
    encoder = en.OneHotEncoder.fit(df, ["source", "month"])
    return encoder.transform(df.select("review_id", "source", "month")).select("review_id", *encoder.names())


_FREQUENCY = from_stage("cleaned", f"""
SELECT c.review_id, c.app_version, {r6('CAST(f.n AS DOUBLE) / (SELECT count(*) FROM cleaned)', 'app_version_freq')}
FROM cleaned c JOIN (SELECT app_version, count(*) AS n FROM cleaned GROUP BY 1) f
 ON f.app_version IS NOT DISTINCT FROM c.app_version""")


@query("frequency_encode", _FREQUENCY)
def frequency_encode(spark, sf_dir):
    return en.frequency_encode(fx.cleaned_short(spark, sf_dir).select("review_id", "app_version"), "app_version")


@query("frequency_join", _FREQUENCY)
def frequency_join(spark, sf_dir):
    """The same join with the broadcast refused: the salted shuffle must give the same rows."""
    df = fx.cleaned_short(spark, sf_dir).select("review_id", "app_version")
    table = en.frequency_table(df, "app_version")
    return lookup_join(df, table, {"app_version": "_value"}, max_rows=0)


@query("label_code_join", from_stage("features", """
SELECT review_id, sentiment_coarse, coalesce(code, -1) AS label FROM features LEFT JOIN (
 SELECT sentiment_coarse, row_number() OVER (ORDER BY sentiment_coarse) - 1 AS code
 FROM (SELECT DISTINCT sentiment_coarse FROM features WHERE sentiment_coarse IS NOT NULL AND score <> 3))
USING (sentiment_coarse)"""))
def label_code_join(spark, sf_dir):
    df = fx.features(spark, sf_dir).select("review_id", "sentiment_coarse", "score")
    known = df.filter(F.col("score") != 3)
    return en.encode_labels(df, known, "sentiment_coarse").select("review_id", "sentiment_coarse", "label")


# --- splits --------------------------------------------------------------------
@query("stratified_split", from_stage("split", "SELECT row_key, sentiment_coarse, dataset FROM split"))
def stratified_split(spark, sf_dir):
    rows = ft.model_rows(fx.features(spark, sf_dir)).select("row_key", "sentiment_coarse")
    return sp.stratified_split(rows, "sentiment_coarse", ["row_key"])


@query("random_split", """
SELECT event_id, CASE WHEN rk <= (SELECT ceil(CAST(0.2 AS DOUBLE) * count(*)) FROM events) THEN 'test' ELSE 'train' END AS dataset
FROM (SELECT event_id, row_number() OVER (ORDER BY substr(md5(concat('42|', CAST(event_id AS VARCHAR))), 1, 13)) AS rk
 FROM events)""")
def random_split(spark, sf_dir):
    return sp.random_split(fx.table(spark, sf_dir, "events").select("event_id"), ["event_id"])


_BALANCE = f"""
SELECT dataset, sentiment_coarse, count(*) AS n, {r6('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dataset)', 'pct')}
FROM split GROUP BY 1, 2"""


@query("split_class_balance", from_stage("split", _BALANCE))
def split_class_balance(spark, sf_dir):
    rows = ft.model_rows(fx.features(spark, sf_dir)).select("row_key", "sentiment_coarse")
    return sp.split_class_balance(sp.stratified_split(rows, "sentiment_coarse", ["row_key"]), "sentiment_coarse")


@query("union_splits", from_stage("split", "SELECT row_key, dataset, sentiment_coarse AS target FROM split"))
def union_splits(spark, sf_dir):
    table = fx.model_data(spark, sf_dir).table.select("row_key", "dataset", "target")
    part = lambda name: table.filter(F.col("dataset") == name).drop("dataset")
    return sp.union_splits(part("train"), part("val"), part("test"))


# --- imputation, scaling, selection ----------------------------------------------
_VALUES = ["value", "spend"]
_GAPS = """
gaps AS (
 SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, value * value AS spend, 5.0 AS flat,
  CASE WHEN substr(md5(concat('42|', CAST(event_id AS VARCHAR))), 1, 1) < '4' THEN 'test' ELSE 'train' END AS dataset
 FROM events
)"""


def _gaps(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    digest = F.md5(F.concat(F.lit("42|"), F.col("event_id").cast("string")))
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        (F.col("value") * F.col("value")).alias("spend"),
        F.lit(5.0).alias("flat"),
        F.when(F.substring(digest, 1, 1) < "4", "test").otherwise("train").alias("dataset"),
    )


@query("impute_median", f"""
WITH {_GAPS}
SELECT event_id, {r6("coalesce(value, (SELECT median(value) FROM gaps WHERE dataset = 'train'))", 'value')} FROM gaps""")
def impute_median(spark, sf_dir):
    df = _gaps(spark, sf_dir)
    return sc.MedianImputer.fit(training_part(df), ["value"]).transform(df).select("event_id", "value")


def _scaled_sql(shift: str, width: str) -> str:
    columns = ", ".join(
        r6(f"({c} - (SELECT {shift.format(c)} FROM gaps WHERE dataset = 'train')) / "
           f"(SELECT CASE WHEN {width.format(c)} = 0 THEN 1 ELSE {width.format(c)} END FROM gaps WHERE dataset = 'train')", c)
        for c in ("value", "spend", "flat")
    )
    return f"WITH {_GAPS} SELECT event_id, {columns} FROM gaps"


def _scaled(kind):
    def run(spark, sf_dir):
        df = _gaps(spark, sf_dir)
        scaler = sc.LinearScaler.fit(training_part(df), ["value", "spend", "flat"], kind)
        return scaler.transform(df).drop("dataset")

    return run


query("standard_scale", _scaled_sql("avg({0})", "stddev_pop({0})"))(_scaled("standard"))
query("minmax_scale", _scaled_sql("min({0})", "max({0}) - min({0})"))(_scaled("minmax"))


@query("inverse_scale", f"WITH {_GAPS} SELECT event_id, {r6('value')}, {r6('spend')} FROM gaps")
def inverse_scale(spark, sf_dir):
    df = _gaps(spark, sf_dir)
    scaler = sc.LinearScaler.fit(training_part(df), _VALUES)
    return scaler.inverse(scaler.transform(df)).select("event_id", *_VALUES)


_TRAIN_FIT = "fit AS (SELECT " + ", ".join(
    f"median(CAST({c} AS DOUBLE)) AS med_{c}, min(coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM split WHERE dataset = 'train'))) AS lo_{c}, "
    f"max(coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM split WHERE dataset = 'train'))) AS hi_{c}"
    for c in MATRIX
) + " FROM split WHERE dataset = 'train')"
_MATRIX_SQL = "matrix AS (SELECT row_key, dataset, sentiment_coarse AS target, " + ", ".join(
    f"(coalesce({c}, med_{c}) - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END AS {c}" for c in MATRIX
) + " FROM split, fit)"


def _matrix(spark, sf_dir):
    """All features of the three parts, min-max scaled with the training part's parameters; made once."""
    model = lambda: prepare_model_data(fx.features(spark, sf_dir), scaler="minmax").table
    return fx._once(spark, sf_dir, "minmax matrix", model).select("row_key", "dataset", "target", *MATRIX)


def _on_matrix(select: str, *extra: str) -> str:
    return from_stage("split", select, _TRAIN_FIT, _MATRIX_SQL, *extra)


@query("preprocess_pipeline", _on_matrix(
    f"SELECT row_key, dataset, target, {', '.join(r6(c) for c in MATRIX)} FROM matrix"))
@query("preprocess_features", _on_matrix(
    f"SELECT row_key, dataset, target, {', '.join(r6(c) for c in MATRIX)} FROM matrix"))
def preprocess_features(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("column_bind", _on_matrix(f"SELECT dataset, {', '.join(r6(c) for c in MATRIX)}, target FROM matrix"))
def column_bind(spark, sf_dir):
    return fx.model_data(spark, sf_dir).table.select("dataset", *MATRIX, "target")


def _anova(features: list[str], source: str, label: str) -> str:
    per = "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS position, {label} AS label, count({f}) AS n, avg({f}) AS m, var_pop({f}) AS v "
        f"FROM {source} GROUP BY {label}"
        for i, f in enumerate(features)
    )
    return f"""
per_class AS ({per}),
anova AS (
 SELECT feature, position, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / nullif(sum(n * v) / (sum(n) - count(*)), 0) AS score
 FROM (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM per_class)
 GROUP BY feature, position
)"""


_TRAIN_MATRIX = "train_matrix AS (SELECT * FROM matrix WHERE dataset = 'train')"


@query("anova_f_scores", _on_matrix(
    f"SELECT feature, CAST(position AS INTEGER) AS position, {r6('score')} FROM anova",
    _TRAIN_MATRIX, _anova(MATRIX, "train_matrix", "target")))
def anova_f_scores(spark, sf_dir):
    return sl.anova_f_scores(training_part(_matrix(spark, sf_dir)), MATRIX, "target")


_K_BEST = "kept AS (SELECT * FROM anova ORDER BY score DESC NULLS LAST, position DESC LIMIT 6)"


@query("select_k_best", _on_matrix(
    "SELECT feature, CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS place FROM kept",
    _TRAIN_MATRIX, _anova(MATRIX, "train_matrix", "target"), _K_BEST))
def select_k_best(spark, sf_dir):
    chosen = sl.select_k_best(training_part(_matrix(spark, sf_dir)), MATRIX, "target", 6)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(chosen)], "feature string, place int")


@query("top_features", _on_matrix(
    f"SELECT feature, {r6('score')} FROM anova ORDER BY score DESC NULLS LAST, position DESC LIMIT 10",
    _TRAIN_MATRIX, _anova(MATRIX, "train_matrix", "target")))
def top_features(spark, sf_dir):
    scores = sl.anova_f_scores(training_part(_matrix(spark, sf_dir)), MATRIX, "target")
    return sl.k_best(scores, 10).select("feature", "score")


@query("write_selected_features", _on_matrix(
    f"SELECT feature, {r6('score')} FROM anova ORDER BY score DESC NULLS LAST, position DESC "
    "LIMIT 13",
    _TRAIN_MATRIX, _anova(MATRIX, "train_matrix", "target")))
def write_selected_features(spark, sf_dir):
    path = stage_path(spark, "selected")
    data = fx.model_data(spark, sf_dir)
    writers.write_selected_features(data.scores.select("feature", "score"), path)
    return readers.read_csv(spark, path).withColumn("score", to_number(F.col("score")))


@query("choose_k", from_stage("split", """
SELECT count(*) AS train_rows, 13 AS k FROM split WHERE dataset = 'train'"""))
def choose_k(spark, sf_dir):
    meta = fx.model_data(spark, sf_dir).metadata
    return meta.select("train_rows", "k")


@query("describe_features", _on_matrix("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')}, "
    + ", ".join(r6(f"quantile_cont({c}, {p})", n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + f", {r6(f'max({c})', 'max')} FROM matrix WHERE dataset = 'train'"
    for c in MATRIX[:5])))
def describe_features(spark, sf_dir):
    data = fx.model_data(spark, sf_dir)
    return ft.describe_features(training_part(data.table), data.features[:5])


@query("nan_inf_check", from_stage("split", """
SELECT dataset, CAST(sum(CAST(year IS NULL AS BIGINT) + CAST(month IS NULL AS BIGINT)) AS BIGINT) AS n_missing,
 CAST(count_if(thumbs_up = 0) AS BIGINT) AS n_infinite FROM split GROUP BY 1"""))
def nan_inf_check(spark, sf_dir):
    rows = ft.model_rows(fx.features(spark, sf_dir))
    split = sp.stratified_split(rows, "sentiment_coarse", ["row_key"])
    infinite = F.when(F.col("thumbs_up") == 0, F.lit(float("inf"))).otherwise(F.col("thumbs_up").cast("double"))
    return ft.nan_inf_check(split.withColumn("inverse_votes", infinite), ["year", "month", "inverse_votes"])


@query("scaling_verification", f"""
WITH {_GAPS}, s AS (
 SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value,
  (spend - avg(spend) OVER ()) / stddev_pop(spend) OVER () AS spend FROM gaps WHERE dataset = 'train')
SELECT abs(round((avg(value) + avg(spend)) / 2, 6)) AS mean_of_means,
 {r6('(stddev_pop(value) + stddev_pop(spend)) / 2', 'mean_of_stds')}, true AS verified FROM s""")
def scaling_verification(spark, sf_dir):
    train = training_part(_gaps(spark, sf_dir))
    scaled = sc.LinearScaler.fit(train, _VALUES).transform(train)
    checked = ft.scaling_verification(scaled, _VALUES)
    return checked.withColumn("mean_of_means", F.abs(F.round("mean_of_means", 6)))


@query("stage_summary", from_stage("split", """
SELECT 'cleaned' AS stage, count(*) AS n_rows, 11 AS n_columns FROM cleaned
UNION ALL SELECT 'features', count(*), 13 FROM split
UNION ALL SELECT 'train split', count(*), 13 FROM split WHERE dataset = 'train'
UNION ALL SELECT 'selected', count(*), 13 FROM split WHERE dataset = 'train'"""))
def stage_summary_query(spark, sf_dir):
    return stage_summary(fx.cleaned_once(spark, sf_dir), fx.features(spark, sf_dir), fx.model_data(spark, sf_dir))
