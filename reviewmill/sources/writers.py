"""Writing tables, pages, models and reports. All data writes are distributed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.constants import PAGE_ROWS
from reviewmill.operators.boosting import BoostedTrees
from reviewmill.operators.ordering import WIDE_ROWS, page_index, parts_of
from reviewmill.operators.svm import LinearClassifier
from reviewmill.session import cut_lineage, release_shuffles
from reviewmill.sources.readers import list_files

CSV_FILE_ROWS = 1_000_000  # multi-line CSV is read one file per task: keep files bounded


def _csv_writer(df: DataFrame):
    return (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", '""')
        .option("maxRecordsPerFile", CSV_FILE_ROWS)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def write_csv(df: DataFrame, path: str, skip_empty: bool = True) -> bool:
    """Overwrite ``path`` with CSV files. An empty table is skipped, and False returned."""
    if skip_empty and df.isEmpty():
        return False
    _csv_writer(df).mode("overwrite").csv(path)
    return True


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_twin(df: DataFrame, csv_path: str, parquet_path: str) -> None:
    """The same table as CSV and as Parquet; the CSV is made from the Parquet copy."""
    write_parquet(df, parquet_path)
    release_shuffles(df.sparkSession)  # those of the Parquet copy: the CSV, several times its size, needs none
    write_csv(df.sparkSession.read.parquet(parquet_path), csv_path, skip_empty=False)


def write_pages(df: DataFrame, path: str, order_by: list, rows: int = PAGE_ROWS) -> None:
    """Every page of ``rows`` rows as its own ``page_no=`` folder: one file, in order, with ``row_no``.

    A page is bounded, so each is sorted in one task; the pages are spread over all tasks.
    """
    numbered = page_index(df, order_by, rows)
    release_shuffles(df.sparkSession)  # the rows are written in order by now: the sort's files go before they are dealt to pages
    paged = numbered.repartition(parts_of(df, WIDE_ROWS), "page_no").sortWithinPartitions("page_no", "row_no")
    _csv_writer(paged).mode("overwrite").partitionBy("page_no").csv(path)


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*.parquet", newest_first: bool = False):
    """file_name, size_mb, n_rows, modified_at per Parquet file; rows come from file metadata."""
    files = list_files(spark, folder, pattern)
    counted = (
        spark.read.schema("_none int")
        .option("pathGlobFilter", pattern)
        .parquet(folder)
        .groupBy(F.col("_metadata.file_name").alias("file_name"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    order = [F.col("modified_at").desc(), "file_name"] if newest_first else ["file_name"]
    return (
        files.join(counted, "file_name", "left")
        .select("file_name", (F.col("size_bytes") / (1024 * 1024)).alias("size_mb"), "n_rows", "modified_at")
        .orderBy(*order)
    )


def write_feature_splits(df: DataFrame, path: str) -> None:
    """Selected features and target, one folder per split."""
    write_parquet(df, path, ["dataset"])


def write_selected_features(scores: DataFrame, path: str) -> None:
    write_csv(scores.orderBy(F.col("score").desc_nulls_last(), "feature").coalesce(1), path)


def write_run_metadata(meta: DataFrame, path: str) -> None:
    """One-row metadata table as JSON, stamped with the run date."""
    stamped = meta.withColumn("run_date", F.current_timestamp().cast("string"))
    stamped.write.mode("overwrite").json(path)


def write_model(model, folder: str, name: str, stamp: str | None = None) -> str:
    """Save a fitted model as ``<name>_<time stamp>`` and return its path."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = f"{folder}/{name}_{stamp}"
    if isinstance(model, (LinearClassifier, BoostedTrees)):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def eval_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON document: each small report table becomes an array under its name."""
    doc = None
    for name, table in parts.items():
        rows = table.agg(F.collect_list(F.struct(*table.columns))).scalar()
        frame = table.sparkSession.range(1) if doc is None else doc
        doc = frame.withColumn(name, rows)
    return doc.select(F.to_json(F.struct(*parts)).alias("value"))


def write_eval_report(parts: dict[str, DataFrame], path: str) -> None:
    eval_report(parts).write.mode("overwrite").text(path)


def write_keyword_csvs(top: DataFrame, path: str) -> None:
    """keyword, n per (group, category) folder, most frequent first; a group without rows has a header only.

    The table has at most a top list per group, and the four groups are written one by one.
    """
    top = cut_lineage(top)
    for group in ("low", "high"):
        for category in ("Emotional", "Functional"):
            here = (F.col("score_group") == group) & (F.col("category") == category)
            rows = top.filter(here).select("keyword", "n").orderBy(F.desc("n"), "keyword").coalesce(1)
            _csv_writer(rows).mode("overwrite").csv(f"{path}/score_group={group}/category={category}")
