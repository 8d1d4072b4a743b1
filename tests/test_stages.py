"""Texts are cleaned and written once; what decides between copies is the same as on whole rows."""

import datetime as dt

from pyspark.sql import functions as F

from reviewmill.operators import dedup
from reviewmill.plans import cleaning, fixtures

T = [dt.datetime(2024, 1, 1, h) for h in range(3)]
SCHEMA = "review_id string, user string, content string, score double, thumbs_up bigint, app_version string, created_at timestamp_ntz, source string"


def test_newest_without_text_keeps_the_rows_of_whole_row_dedup(make):
    rows = [
        ("a", "u", "later text", 1.0, 1, "v1", T[1], "s"), ("a", "u", "early text", 1.0, 9, "v1", T[1], "s"),  # the text decides
        ("a", "u", "aaa", 1.0, 1, "v1", T[0], "s"), ("b", None, "x", 2.0, 1, None, None, "s"), ("b", None, "w", 2.0, 1, None, None, "s"),
        ("c", "u", "same", 1.0, 3, "v2", T[2], "s"), ("c", "u", "same", 1.0, 3, "v1", T[2], "s"), ("c", "u", "same", 1.0, 3, "v1", T[2], "s"),
        (None, "u", "p", 1.0, 1, "v1", T[0], "s"), (None, "u", "p", 1.0, 2, "v1", T[1], "s"), (None, "w", "p", 1.0, 1, "v1", T[0], "s"),
        (None, None, "p", None, None, None, None, None), (None, None, "q", None, None, None, None, None),
    ]
    df = make(rows, SCHEMA)
    keyed = cleaning.keyed_rows(df)
    facts = dedup.newest_without_text(keyed)
    assert "content" not in facts.columns
    got = facts.join(keyed.select("_row", "content"), "_row").select(*df.columns).collect()
    want = dedup.dedup_newest_by_id(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 7


def test_texts_are_written_once_for_features_and_points(spark, monkeypatch):
    from reviewmill.plans import queries_models

    written = {}
    real = cleaning.write_stage

    def noted(df, name):
        written[name] = "content" in df.columns
        return real(df, name)

    for module in (cleaning, fixtures, queries_models):
        monkeypatch.setattr(module, "write_stage", noted)
    fixtures.forget_stages()
    try:
        fixtures.features(spark, "/root/testdata/sf0.001")
        queries_models._points(spark, "/root/testdata/sf0.001")
        assert [name for name, text in written.items() if text] == ["clean-rows"]
        assert {"unique-rows", "features", "points"} <= set(written)
    finally:
        fixtures.forget_stages()


def test_reviews_are_dealt_by_their_number(spark, make, monkeypatch):
    monkeypatch.setattr(fixtures, "WIDE_ROWS", 10)
    events = make([(i, T[0], 1, "view", 1.0) for i in range(200)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    documents = make([(i, f"t{i}") for i in range(40)], "doc_id bigint, text string")
    made = fixtures.reviews_from(events, documents)
    assert made.rdd.getNumPartitions() >= 10 and made.count() == 200
    assert made.filter(F.col("content").isNull()).count() == sum(i % 101 == 0 for i in range(200))


def test_row_index_of_wide_rows_in_more_parts(make):
    from reviewmill.operators.ordering import page_index, with_row_index

    df = make([(i % 7, f"{i % 5}") for i in range(60)], "g int, k string")
    keys = [F.col("g").desc(), "k"]
    many = with_row_index(df, keys, rows_per_part=5)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, with_row_index(df, keys).collect()))
    assert page_index(df, keys, 25).groupBy("page_no").count().orderBy("page_no").collect()[-1]["count"] == 10


def test_archive_merges_a_bucket_in_shares(spark, make, tmp_path, monkeypatch):
    from reviewmill.streaming import master

    monkeypatch.setattr(master, "SHARE_ROWS", 10)
    rows = [(f"r{i % 90}" if i % 10 else None, f"u{i % 4}", f"t{i % 6}", 1.0, i, "v", T[i % 3], "s") for i in range(200)]
    df = make(rows, SCHEMA)
    archive = master.ReviewArchive(spark, str(tmp_path), buckets=2)
    for batch in range(2):
        archive.write_batch(df.filter(F.col("thumbs_up") % 2 == batch), batch)
    archive.compact()
    files = list(tmp_path.glob("runs/*/_bucket=0/*.parquet"))
    assert len(files) > 1
    got, want = archive.read().select(*df.columns).collect(), dedup.dedup_newest_by_id(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_forest_keeps_node_ids(make):
    from reviewmill.operators import models

    df = models.assemble(make([(float(i % 2), float(i)) for i in range(40)], "label double, x double"), ["x"])
    model = models.fit_random_forest(df.select("label", "features"), trees=2, depth=2)
    assert model.getCacheNodeIds() and model.getCheckpointInterval() == -1


def _wide_stages(monkeypatch):
    """Names of the stages that are written with their text, as they come."""
    from reviewmill.plans import queries_models

    wide = []
    real = cleaning.write_stage

    def noted(df, name):
        if "content" in df.columns:
            wide.append(name)
        return real(df, name)

    for module in (cleaning, fixtures, queries_models):
        monkeypatch.setattr(module, "write_stage", noted)
    return wide


def test_queries_without_text_write_none_again(spark, monkeypatch):
    from reviewmill.plans.catalog import QUERIES

    wide = _wide_stages(monkeypatch)
    fixtures.forget_stages()
    names = (
        "complete_cases", "length_stats", "chart_sentiment_area", "chart_monthly_rating", "month_version_join", "sentiment_trend",
        "log_thumbs_up", "page_ranges", "page_index", "sort_newest_first", "engineer_features", "keyword_group_stats", "chart_keyword_proportion",
        "write_keyword_csvs", "stage_summary", "project_final_columns", "write_parquet",
    )
    try:
        for name in names:
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
        assert wide == ["clean-rows"]
    finally:
        fixtures.forget_stages()


def test_features_and_keywords_of_texts_beside_the_rows(make):
    from reviewmill.operators.features import engineer_features
    from reviewmill.operators.keywords import annotate_keywords, count_keywords, keyword_counts

    rows = [(i, f"Great video, crash {'!' * (i % 3)} ÄB x{i}", float(1 + i % 5), i, T[i % 3]) for i in range(30)]
    df = make(rows, "_row bigint, content string, score double, thumbs_up bigint, created_at timestamp_ntz")
    whole = engineer_features(df).drop("content")
    beside = engineer_features(df.drop("content"), texts=df.select("_row", "content")).select(*whole.columns)
    assert sorted(map(repr, beside.collect())) == sorted(map(repr, whole.collect()))
    some = df.filter("_row % 4 > 0")
    counted = count_keywords(annotate_keywords(df).drop("content").join(some.select("_row"), "_row", "left_semi"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, keyword_counts(some).collect()))


def test_files_of_finished_shuffles_are_released(spark, make, tmp_path, monkeypatch):
    from reviewmill.sources import writers
    from reviewmill.streaming import master

    calls = []
    monkeypatch.setattr(writers, "release_shuffles", lambda spark: calls.append("pages"))
    monkeypatch.setattr(master, "release_shuffles", lambda spark: calls.append("batch"))
    df = make([(f"r{i}", "u", f"t{i}", 1.0, i, "v", T[i % 3], "s") for i in range(20)], SCHEMA)
    writers.write_pages(df, str(tmp_path / "pages"), ["created_at", "review_id"], rows=6)
    df.repartition(2).write.parquet(str(tmp_path / "inbox"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "inbox"))
    archive = master.ReviewArchive(spark, str(tmp_path / "archive"), buckets=2)
    archive.stream_from(stream).awaitTermination()
    assert calls == ["pages", "batch", "batch"] and archive.read().count() == 20


def test_all_models_of_k_means_are_assigned_at_once():
    import numpy as np

    from reviewmill.operators.minibatch import _assign, _sums

    rng = np.random.default_rng(1)
    x, ks, starts = rng.normal(size=(300, 3)), [2, 4], 3
    centres = rng.normal(size=(starts * sum(ks), 3))
    centres[1] = centres[0]  # equally near: the first
    nearest, least = _assign(x, centres, ks, starts)
    counts, sums = _sums(x, nearest, len(centres))
    at = 0
    for model, k in enumerate(k for k in ks for _ in range(starts)):
        square = ((x[:, None] - centres[None, at : at + k]) ** 2).sum(axis=2)
        assert (nearest[:, model] == at + square.argmin(axis=1)).all() and np.allclose(least[:, model], square.min(axis=1))
        for c in range(at, at + k):
            mine = x[nearest[:, model] == c]
            assert counts[c] == len(mine) and np.allclose(sums[c], mine.sum(axis=0))
        at += k
