"""Operators on inline rows: ties, nulls, empty tables and definitions that differ between engines."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from reviewmill.functions.reviews import row_key
from reviewmill.operators import dedup, encoding, evaluation, features, filters, harmonize, keywords, lookup
from reviewmill.operators import order_stats, ordering, quality, scaling, selection, splits, trends

REVIEWS = "review_id string, user string, content string, score double, thumbs_up bigint, app_version string, created_at string, source string"


def reviews(make, rows):
    return make(rows, REVIEWS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def review(review_id=None, user="u", content="c", score=5.0, votes=0, version="v1", at="2024-01-01 00:00:00", source="s"):
    return (review_id, user, content, score, votes, version, at, source)


def test_harmonize_coalesces_synonyms_and_adds_missing(make):
    raw = make([("1", None, "b", " 4 ", "x"), ("2", "a", "c", "bad", "2024-03-01")], "ID string, Review string, content string, stars string, At string")
    got = harmonize.harmonize_columns(raw, "web")
    assert got.columns == ["review_id", "user", "content", "score", "thumbs_up", "app_version", "created_at", "source"]
    rows = {r["review_id"]: r for r in got.collect()}
    assert (rows["1"]["content"], rows["1"]["score"], rows["1"]["created_at"]) == ("b", 4.0, None)
    assert (rows["2"]["content"], rows["2"]["score"], str(rows["2"]["created_at"])) == ("a", None, "2024-03-01 00:00:00")
    assert rows["1"]["source"] == "web" and rows["1"]["thumbs_up"] is None
    assert harmonize.harmonize_columns(raw.limit(0), "web").count() == 0


def test_resolvers(make):
    df = make([(1, 2.0, True, "x")], "a int, Rating_avg double, flag boolean, TEXT string")
    assert harmonize.resolve_column(df, ["content", "text"]) == "TEXT"
    assert harmonize.resolve_column(df, ["nope"], required=False) is None
    with pytest.raises(ValueError):
        harmonize.resolve_column(df, ["nope"])
    assert harmonize.resolve_target(df) == "Rating_avg"
    with pytest.raises(ValueError):
        harmonize.resolve_target(df.select("a"))
    assert harmonize.numeric_columns(df) == ["a", "Rating_avg"]


def test_anonymous_users(make):
    rows = [
        review("r1", "Google User"), review("r2", " NaN "), review("r3", "a google user"), review(None, None, "b", at="2024-01-02 00:00:00"),
        review(None, "none", "a", at="2024-01-01 00:00:00"), review(None, "kept"),
    ]
    got = {(r["review_id"], r["content"]): r["user"] for r in harmonize.fill_anonymous_user(reviews(make, rows)).collect()}
    assert got == {
        ("r1", "c"): "anon_r1", ("r2", "c"): "anon_r2", ("r3", "c"): "a google user",
        (None, "a"): "anon_idx_0", (None, "b"): "anon_idx_1", (None, "c"): "kept",
    }


def test_dedup_by_id(make):
    rows = [
        review("a", content="old", at="2024-01-01 00:00:00"), review("a", content="new", at="2024-01-03 00:00:00"),
        review("a", content="undated", at=None), review("b", content="tie2"), review("b", content="tie1"),
        review(None, content="n1", at="2024-01-01 00:00:00"), review(None, content="n2", at="2024-02-01 00:00:00"),
    ]
    df = reviews(make, rows)
    keep = lambda d: sorted(r["content"] for r in dedup.dedup_newest_by_id(d).collect())
    assert keep(df) == ["n1", "n2", "new", "tie1"]
    assert keep(df.drop("user")) == ["n1", "n2", "new", "tie1"]
    once = dedup.dedup_newest_by_id(df)
    assert once.count() == dedup.dedup_newest_by_id(once).count()


def test_rows_without_id_are_told_apart_by_user_and_text(make):
    rows = [review("a"), review("a"), review(None, user="u", content="x"), review(None, user="v", content="x"), review(None, user="v", content="x")]
    assert dedup.dedup_newest_by_id(reviews(make, rows)).count() == 3
    assert dedup.dedup_newest_by_id(reviews(make, rows[2:])).count() == 2


def test_row_key_is_unique_and_never_null(make):
    rows = [review("a"), review("b")] + [review(None, user=u, content=c) for u in ("u", None) for c in ("x", "y")]
    keys = [r["k"] for r in reviews(make, rows).select(row_key().alias("k")).collect()]
    assert len(set(keys)) == 6 and None not in keys


def test_dedup_without_any_id_uses_user_and_content(make):
    df = reviews(make, [review(user="a"), review(user="a", at="2024-05-01 00:00:00"), review(user="b"), review(user=None), review(user=None)])
    got = dedup.dedup_newest_by_id(df)
    assert got.count() == 3
    assert dedup.duplicate_count(df).first()["duplicates"] == 2
    assert got.filter("user = 'a'").first()["created_at"].month == 5


def test_merge_newest_ignores_arrival_order(make):
    a = reviews(make, [review("a", content="1"), review("b", content="2", at="2024-02-01 00:00:00")])
    b = reviews(make, [review("a", content="3", at="2024-03-01 00:00:00"), review("b", content="4")])
    rows = lambda df: sorted(r["content"] for r in df.collect())
    assert rows(dedup.merge_newest(a, b)) == rows(dedup.merge_newest(b, a)) == ["2", "3"]
    assert rows(dedup.merge_newest(None, a)) == ["1", "2"]


def test_hot_key_dedup_is_pruned_before_the_shuffle(make, spark):
    df = reviews(make, [review("hot", content=str(i)) for i in range(50)] + [review("cold")])
    plan = dedup.dedup_newest_by_id(df)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the shuffle


@pytest.mark.parametrize("limit", [5, 50, 10_000])
def test_exact_quantiles_small_and_bracketed(make, monkeypatch, limit):
    monkeypatch.setattr(order_stats, "RANK_ROWS", limit)
    monkeypatch.setattr(order_stats, "ACCURACY", 20)
    values = [1.0] * 300 + [float(i * i % 977) for i in range(500)] + [5000.0, -3.5, None]
    df = make([(v,) for v in values], "v double").repartition(5)
    clean = sorted(v for v in values if v is not None)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = order_stats.exact_quantiles(df, {"v": F.col("v")}, probs)["v"]
    for p, g in zip(probs, got):
        at = p * (len(clean) - 1)
        low, high = clean[math.floor(at)], clean[math.ceil(at)]
        assert g == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_quantiles_of_the_documented_example(make):
    df = make([(float(v),) for v in (1, 2, 3, 10, 50)], "v double")
    assert order_stats.exact_quantiles(df, {"v": F.col("v")}, [0.99])["v"][0] == pytest.approx(48.4)
    stats = features.distribution_stats(df, ["v"]).first()
    assert stats["skewness"] == pytest.approx(2.0856, abs=1e-4)
    assert stats["std"] == pytest.approx(20.8734, abs=1e-4)
    assert stats["median"] == 3.0
    assert order_stats.exact_quantiles(df.limit(0), {"v": F.col("v")}, [0.5])["v"] == [None]


def test_skew_of_constant_and_tiny_columns(make):
    constant = features.distribution_stats(make([(7.1,)] * 9, "v double"), ["v"]).first()
    assert constant["skewness"] == 0.0
    assert features.distribution_stats(make([(1.0,), (2.0,)], "v double"), ["v"]).first()["skewness"] is None


def test_row_index_and_pages(make):
    df = make([(i % 7, f"k{i:03d}") for i in range(100)], "g int, k string").repartition(6)
    rows = ordering.with_row_index(df, [F.col("g").desc(), F.col("k")]).collect()
    expected = sorted(((r["g"], r["k"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert [(r["g"], r["k"]) for r in sorted(rows, key=lambda r: r["row_index"])] == expected
    pages = ordering.page_index(df, ["k"], 30).groupBy("page_no").count().collect()
    assert {r["page_no"]: r["count"] for r in pages} == {1: 30, 2: 30, 3: 30, 4: 10}
    assert ordering.page_index(df.limit(0), ["k"], 30).count() == 0


def test_row_index_numbers_exact_copies(make):
    df = make([("same",)] * 40, "k string").repartition(4)
    assert sorted(r["row_index"] for r in ordering.with_row_index(df, ["k"]).collect()) == list(range(40))


@pytest.mark.parametrize("top", [1000, 0])
def test_page_slice_paths_agree(make, monkeypatch, top):
    monkeypatch.setattr(ordering, "TOP_ROWS", top)
    rows = [(f"k{i:02d}", f"2024-01-{1 + i % 9:02d} 00:00:00" if i % 5 else None) for i in range(50)]
    df = make(rows, "k string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    ordered = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))
    page = lambda p: [r["k"] for r in ordering.page_slice(df, p, 20, "created_at", ("k",)).collect()]
    first = [k for k, _ in ordered[:20]]
    assert sorted(page(-1)) == sorted(page(0)) == sorted(page(1)) == sorted(first)
    assert sorted(page(3)) == sorted(k for k, _ in ordered[40:])
    assert page(4) == []


def test_page_ranges(make):
    got = ordering.page_ranges(make([(i,) for i in range(45)], "i int"), 20).orderBy("page_no").collect()
    assert [(r["first_row"], r["last_row"]) for r in got] == [(1, 20), (21, 40), (41, 45)]
    assert ordering.page_total(0, 20) == 1 and ordering.page_total(41, 20) == 3


def test_sample_is_exact_and_repeatable(make):
    df = make([(f"k{i}",) for i in range(500)], "k string")
    a = {r["k"] for r in ordering.sample_rows(df, 120, ["k"]).collect()}
    b = {r["k"] for r in ordering.sample_rows(df.repartition(3), 120, ["k"]).collect()}
    assert a == b and len(a) == 120
    assert a != {r["k"] for r in ordering.sample_rows(df, 120, ["k"], seed=7).collect()}
    assert ordering.sample_rows(df, 500, ["k"]).count() == 500


def test_release_markers_keep_all_months_and_label_fewer(spark):
    months = spark.sql("SELECT add_months(date'2020-01-31', CAST(id AS INT)) AS first_seen_month FROM range(17)")
    few = months.filter("first_seen_month < date'2021-05-01'")
    assert (ordering.release_markers(months).count(), ordering.release_markers(months).filter("labelled").count()) == (17, 9)
    assert (ordering.release_markers(few).count(), ordering.release_markers(few).filter("labelled").count()) == (16, 16)


def test_quality_tables(make):
    df = reviews(make, [review("a", score=1.0), review("b", score=2.0), review("c", score=None), review(None, score=2.0, content=" ")])
    assert {r["column_name"]: r["missing"] for r in quality.missing_summary(df).collect()} == {"score": 1, "review_id": 1}
    assert quality.missing_total(df).first()[0] == 2
    ratings = quality.rating_distribution(df).collect()
    assert [(r["score"], r["n"], r["pct"]) for r in ratings] == [(1.0, 1, 25.0), (2.0, 2, 50.0)]
    assert ratings[1]["bar"] == "█" * 25
    report = filters.blank_content_report(df).first()
    assert (report["rows_before"], report["rows_removed"], report["removed_pct"]) == (4, 1, 25.0)
    tied = make([(3.0,), (1.0,), (1.0,), (3.0,), (9.0,)], "score double")
    assert quality.rating_stats(tied).first()["mode"] == 1.0
    empty = quality.date_coverage(df.limit(0)).first()
    assert (empty["valid_dates"], empty["valid_pct"], empty["span_days"]) == (0, None, None)


def test_approximate_quantiles_are_an_option(make):
    df = make([(float(i),) for i in range(1000)], "v double")
    assert quality.quantile_row(df, "v", {"p50": 0.5}, exact=False).first()["p50"] == pytest.approx(499.5, abs=2)


def test_trend_is_dense_and_shares_sum_to_one(make):
    df = reviews(make, [review("a", score=1.0), review("b", score=5.0, version="x"), review("c", score=3.0, at="2024-03-05 00:00:00", version="v2"), review("d", score=None), review("e", at=None)])
    rows = trends.sentiment_trend(df).collect()
    assert [str(r["year_month"])[:10] for r in rows] == ["2024-01-31", "2024-03-31"]
    assert all(r["Negative"] + r["Neutral"] + r["Positive"] == pytest.approx(1.0) for r in rows)
    assert [r["versions_list"] for r in rows] == ["v1", "v2"]
    assert [r["total_count"] for r in rows] == [2, 1]
    assert trends.densify(df).count() == 6
    with pytest.raises(ValueError):
        trends.monthly_mean_rating(df.drop("score"))


def test_keyword_groups_keep_reviews_without_text(make):
    df = reviews(make, [review("a", score=1.0, content="Bug bug crash"), review("b", score=2.0, content=None), review("c", content="nice video"), review("d", score=3.0, content="bug")])
    stats = {r["score_group"]: r for r in keywords.keyword_group_stats(df).collect()}
    assert (stats["low"]["n"], stats["low"]["em_count"], stats["high"]["fn_count"]) == (2, 1, 1)
    summary = {(r["score_group"], r["category"]): r for r in keywords.keyword_summary(df).collect()}
    assert summary["low", "Emotional"]["top_keywords"] == "bug, crash"
    assert summary["low", "Functional"]["top_keywords"] == ""
    assert summary["low", "Emotional"]["prop_pct"] == 50.0
    only_high = keywords.keyword_proportions(df.filter("score = 5")).collect()
    assert len(only_high) == 4


def test_imputer_and_scalers(make):
    train = make([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0), (None, 5.0)], "x double, flat double")
    imputer = scaling.MedianImputer.fit(train, ["x"])
    assert imputer.medians == {"x": 2.5}
    full = imputer.transform(train)
    z = [r["x"] for r in scaling.LinearScaler.fit(full, ["x"]).transform(full).collect()]
    assert statistics.fmean(z) == pytest.approx(0) and statistics.pstdev(z) == pytest.approx(1)
    minmax = scaling.LinearScaler.fit(full, ["x", "flat"], "minmax")
    rows = minmax.transform(full).collect()
    assert {r["flat"] for r in rows} == {0.0} and max(r["x"] for r in rows) == 1.0
    back = minmax.inverse(minmax.transform(full)).collect()
    assert sorted(r["x"] for r in back) == pytest.approx([1, 2, 2.5, 3, 10])


def test_split_sizes_follow_labels():
    sizes = splits.split_sizes({"a": 700, "b": 200, "c": 101})
    assert sum(t for t, _ in sizes.values()) == math.ceil(0.15 * 1001)
    for label, n in {"a": 700, "b": 200, "c": 101}.items():
        assert abs(sizes[label][0] - 0.15 * n) <= 1


def test_stratified_split_is_exact_and_leak_free(make):
    df = make([(f"k{i}", "ab"[i % 3 == 0]) for i in range(300)] + [("none", None)], "k string, y string")
    rows = splits.stratified_split(df, "y", ["k"]).groupBy("y", "dataset").count().collect()
    got = {(r["y"], r["dataset"]): r["count"] for r in rows}
    sizes = splits.split_sizes({"a": 200, "b": 100})
    for label, (test, val) in sizes.items():
        assert (got[label, "test"], got[label, "val"]) == (test, val)
    split = splits.stratified_split(df, "y", ["k"])
    changed = split.withColumn("x", F.when(F.col("dataset") == "train", F.length("k")).otherwise(F.rand() * 1e6))
    train = lambda d: d.filter("dataset = 'train'")
    plain = split.withColumn("x", F.length("k").cast("double"))
    assert scaling.LinearScaler.fit(train(changed), ["x"]) == scaling.LinearScaler.fit(train(plain), ["x"])


def test_random_split_size(make):
    df = make([(i,) for i in range(101)], "i int")
    assert splits.random_split(df, ["i"]).filter("dataset = 'test'").count() == 21


def test_encoders(make):
    train = make([("x", "p"), ("y", "q"), (None, "p")], "a string, b string")
    encoder = encoding.OneHotEncoder.fit(train, ["a", "b"])
    assert encoder.names() == ["a_missing", "a_x", "a_y", "b_q"]
    row = encoder.transform(make([("new", None)], "a string, b string")).first()
    assert [row[n] for n in encoder.names()] == [0.0, 0.0, 0.0, 0.0]
    freq = {r["a"]: r["a_freq"] for r in encoding.frequency_encode(train.union(train.limit(1)), "a").collect()}
    assert freq == {"x": 0.5, "y": 0.25, None: 0.25}
    codes = encoding.encode_labels(make([("q",), ("p",), ("z",), (None,)], "b string"), train, "b").collect()
    assert {r["b"]: r["label"] for r in codes} == {"q": 1, "p": 0, "z": -1, None: -1}
    numeric = encoding.encode_labels(make([(2.0,)], "b double"), train, "b").first()
    assert numeric["label"] == 2


def test_lookup_join_paths_agree(make):
    df = make([("hot" if i % 3 else f"k{i}", i) for i in range(200)] + [(None, -1)], "k string, i int")
    table = df.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = lambda m: sorted(map(str, lookup.lookup_join(df, table, {"k": "key"}, max_rows=m).collect()))
    assert rows(0) == rows(10_000) and len(rows(0)) == 201


def test_anova_and_selection(make):
    rows = [("a", 1.0, 1.0, 7.0), ("a", 2.0, 1.5, 7.0), ("b", 5.0, 1.2, 7.0), ("b", 6.0, 1.1, 7.0), ("c", 9.0, 1.3, 7.0), ("c", 9.5, 1.4, 7.0)]
    df = make(rows, "y string, x double, noise double, flat double")
    scores = {r["feature"]: r["score"] for r in selection.anova_f_scores(df, ["noise", "x", "flat"], "y").collect()}
    groups = [[1.0, 2.0], [5.0, 6.0], [9.0, 9.5]]
    grand = statistics.fmean(v for g in groups for v in g)
    between = sum(2 * (statistics.fmean(g) - grand) ** 2 for g in groups) / 2
    within = sum((v - statistics.fmean(g)) ** 2 for g in groups for v in g) / 3
    assert scores["x"] == pytest.approx(between / within)
    assert scores["flat"] is None
    assert selection.select_k_best(df, ["noise", "x", "flat"], "y", 2) == ["noise", "x"]
    assert [selection.choose_k(13, k) for k in (None, 5, 40)] == [13, 5, 13]


def test_evaluation_against_hand_counts(make):
    rows = [("a", "a")] * 3 + [("a", "b")] * 1 + [("b", "a")] * 2 + [("b", "b")] * 4 + [("c", "z")] * 2
    df = make(rows, "label string, prediction string")
    metrics = {r["class"]: r for r in evaluation.class_metrics(df, "label", "prediction").collect()}
    assert metrics["a"]["precision"] == pytest.approx(3 / 5) and metrics["a"]["recall"] == pytest.approx(3 / 4)
    assert metrics["c"]["f1"] == 0.0 and metrics["z"]["support"] == 0
    overall = evaluation.classification_metrics(df, "label", "prediction").first()
    assert overall["accuracy"] == pytest.approx(7 / 12)
    assert evaluation.confusion_matrix(df, "label", "prediction").count() == 9
    insight = {r["class"]: r for r in evaluation.confusion_insights(df, "label", "prediction").collect()}
    assert (insight["b"]["most_confused"], insight["b"]["confused_count"]) == ("a", 2)
    assert insight["c"]["total"] == 0 or insight["c"]["correct"] == 0
    report = {r["name"]: r for r in evaluation.classification_report(df, "label", "prediction").collect()}
    assert report["macro avg"]["precision"] == pytest.approx((3 / 5 + 4 / 5) / 4)


def test_regression_metrics(make):
    df = make([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = evaluation.regression_metrics(df, "y", "p").first()
    mean = 7 / 3
    assert row["mse"] == pytest.approx(1.25 / 3)
    assert row["r2"] == pytest.approx(1 - 1.25 / sum((v - mean) ** 2 for v in (1, 2, 4)))
    same = evaluation.model_comparison(*[evaluation.regression_metrics(df, "y", "p")] * 2)
    assert {r["better"] for r in same.collect()} == {"linear"}
    assert evaluation.performance_verdict(same).first()["verdict"] == "similar"


def test_nan_and_infinity_are_counted(make):
    df = make([("train", float("nan"), 1.0), ("train", float("inf"), None), ("test", 1.0, float("-inf"))], "dataset string, a double, b double")
    got = {r["dataset"]: (r["n_missing"], r["n_infinite"]) for r in features.nan_inf_check(df, ["a", "b"]).collect()}
    assert got == {"train": (2, 1), "test": (0, 1)}


def test_clean_examples_of_short_texts(make):
    from reviewmill.functions.text import clean_text
    from reviewmill.operators.quality import clean_examples

    texts = ["AT&amp;T  is ok http://x.io/a", "same", "x" * 120 + "  y", "later  too"]
    df = make(list(enumerate(texts)), "i int, t string").withColumn("c", clean_text(F.col("t")))
    got = [tuple(r) for r in clean_examples(df, "t", "c", ["i"]).collect()]
    assert got == [("AT&amp;T  is ok http://x.io/a", "AT&T is ok")]


def test_clean_examples_of_all_rows(make):
    from reviewmill.operators.quality import clean_examples
    from reviewmill.plans.catalog import ORACLES

    df = make([(i, f"{i}  x", f"{i} x") for i in range(9)], "i int, t string, c string")
    assert clean_examples(df, "t", "c", ["i"], rows=None).count() == 9
    assert "LIMIT" not in ORACLES["clean_examples"]
