"""Every cheap query against its SQL twin at the smallest scale, and the entry point."""

import pytest

SF = "/root/testdata/sf0.001"
# Fits that take long even on small data: covered in test_models.py and by tools/check.py.
SLOW = {
    "linear_svc_multiclass", "random_forest_classifier", "feature_importance", "write_model", "write_eval_report",
    "boosted_regression", "boosted_feature_importance", "chart_elbow_silhouette", "choose_k_clusters", "kmeans",
    "kmeans_centroids", "chart_cluster_scatter", "dbscan", "kmeans_facts", "dbscan_facts", "clustered_table", "cluster_summary",
    "classifier_facts", "write_regression_report", "dbscan_clusters", "chart_elbow_facts", "boosted_regression_facts",
}


def names():
    import __spark_entry__ as entry

    # the corpus operators have tests of their own
    return [n for n in entry.queries() if n not in SLOW and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    import check

    return check.connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, con, name):
    import check

    status, detail = check.compare(spark, con, SF, name)
    assert status in ("ok", "rows"), detail


def test_entry_has_rows_and_twins_cover_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
