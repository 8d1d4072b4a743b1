"""Time the headline queries and print one JSON line.

Stages (reviews, merged, cleaned, features, model data) are timed on their own, because the queries
after them read what the stage wrote.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "harmonize_columns", "clean_text", "dedup_newest_by_id", "dedup_newest_by_user_content", "duplicate_count",
    "missing_summary", "rating_distribution", "rating_stats", "thumbs_quantiles", "value_quantiles",
    "monthly_mean_rating", "sentiment_trend", "version_first_seen", "keyword_summary_table", "engineer_features",
    "feature_distribution_stats", "stratified_split", "frequency_encode", "anova_f_scores", "preprocess_features",
    "confusion_insights", "model_comparison", "page_slice", "head_n", "sample_n", "cluster_centroids",
    "silhouette_sampled", "merge_master_newest", "stream_merge_master", "write_page_files", "pca_2d",
]


def main() -> None:
    from reviewmill.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from reviewmill.plans import catalog, fixtures

    only = sys.argv[1:]
    timings: dict[str, float] = {}
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    started = time.perf_counter()
    if os.path.isdir(warm_dir):  # class loading and compilation are not the queries' work
        fixtures.features(spark, warm_dir)
    warm_up = round(time.perf_counter() - started, 3)

    def timed(name, run) -> None:
        started = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name:32} {timings[name]:8.3f}", file=sys.stderr, flush=True)

    for stage in ("raw_reviews", "merged", "cleaned", "features", "model_data"):
        timed(f"stage_{stage}", lambda: getattr(fixtures, stage)(spark, SF_DIR))
    for name in only or HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "review_analytics_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "warm_up": warm_up,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
