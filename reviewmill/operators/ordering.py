"""Total order without a global window: row numbers, pages, first rows, seeded samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import PAGE_ROWS, RELEASE_LABELS_MAX, SEED
from reviewmill.functions.reviews import seeded_hash
from reviewmill.operators.order_stats import non_null_counts, order_statistics
from reviewmill.session import cut_lineage, write_stage

TOP_ROWS = 1_000  # above this, a plain top-n would gather n rows from every task
WIDE_ROWS = 50_000  # rows with a text in one task of a shuffle
_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition above, position below


def newest_first(ts: str = "created_at", *ties: str) -> list[Column]:
    return [F.col(ts).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]


def parts_of(df: DataFrame, rows_per_part: int) -> int:
    """Shuffle partitions that hold no more than about ``rows_per_part`` rows each; not fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_part))


def with_row_index(df: DataFrame, order_by: list, index_col: str = "row_index", rows_per_part: int | None = None) -> DataFrame:
    """0-based position in the total order, computed by a range-partitioned sort.

    Rows are sorted over all tasks, fixed by a checkpoint, and numbered inside their partition;
    the start of each partition comes from one count per partition. The extra last sort key
    spreads a large group of exact copies over several partitions. With ``rows_per_part``, for wide rows, partitions are as
    many as keep each sort in memory, and a compressed stage takes the place of the checkpoint.
    """
    keys, copies = [*order_by, "_copy"], df.withColumn("_copy", F.monotonically_increasing_id())
    if rows_per_part is None:
        ordered = copies.orderBy(*keys)
    else:
        ordered = copies.repartitionByRange(parts_of(df, rows_per_part), *keys).sortWithinPartitions(*keys)
    sorted_rows = ordered.drop("_copy").withColumn("_pos", F.monotonically_increasing_id())
    fixed = cut_lineage(sorted_rows) if rows_per_part is None else write_stage(sorted_rows, "row-index")
    part = F.shiftright("_pos", _LOCAL_BITS)
    sizes = fixed.groupBy(part.alias("part")).count().collect()  # one row per partition
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        starts.append((row["part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    local = F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_start") + local).alias(index_col))
    )


def sort_newest_first(df: DataFrame, ts: str = "created_at", *ties: str) -> DataFrame:
    return df.orderBy(*newest_first(ts, *ties))


def _sort_value(df: DataFrame, name: str) -> Column | None:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(name).cast("double")
    return None


def _keep_newest(df: DataFrame, n: int, ts: str) -> DataFrame:
    """Rows that can be among the first ``n`` by ``ts`` descending: an exact cut-off filter."""
    value = _sort_value(df, ts)
    if value is None:
        return df
    total = non_null_counts(df, {ts: value})[ts]
    if n > total:
        return df
    cut = order_statistics(df, {ts: value}, {ts: [total - n]}, {ts: total})[ts][total - n]
    return df.filter(value >= cut)


def head_rows(df: DataFrame, n: int, ts: str = "created_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """First ``n`` rows, newest first."""
    return rows_between(df, 0, n, ts, ties)


def rows_between(
    df: DataFrame, start: int, stop: int, ts: str = "created_at", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``start`` (inclusive) to ``stop`` (exclusive) of the newest-first order."""
    order = newest_first(ts, *ties)
    if stop <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(stop - start)
    tail = _keep_newest(df, stop, ts)
    index = F.col("row_index")
    return with_row_index(tail, order).filter((index >= start) & (index < stop)).drop("row_index")


def page_slice(
    df: DataFrame,
    page: int,
    rows: int = PAGE_ROWS,
    ts: str = "created_at",
    ties: tuple[str, ...] = (),
    dataset: str = "all",
) -> DataFrame:
    """One page. Pages 0 and 1 are both the first, negatives clamp to it, past the end is empty."""
    if dataset != "all":
        df = df.filter(F.col("dataset") == dataset)
    start = max(page - 1, 0) * rows
    return rows_between(df, start, start + rows, ts, ties)


def page_total(row_count: int, rows: int = PAGE_ROWS) -> int:
    return max(1, math.ceil(row_count / rows))


def page_index(df: DataFrame, order_by: list, rows: int = PAGE_ROWS) -> DataFrame:
    """Every row with its 1-based row and page number."""
    numbered = with_row_index(df, order_by, rows_per_part=WIDE_ROWS)
    return numbered.select(
        *df.columns,
        (F.col("row_index") + 1).alias("row_no"),
        (F.floor(F.col("row_index") / rows) + 1).alias("page_no"),
    )


def page_ranges(df: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """First and last row of every page, from the row count alone."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    pages = F.greatest(F.ceil(F.col("total_rows") / rows), F.lit(1))
    return total.select(
        "total_rows",
        pages.alias("total_pages"),
        F.explode(F.sequence(F.lit(1), pages)).alias("page_no"),
    ).select(
        "page_no",
        "total_pages",
        "total_rows",
        F.least((F.col("page_no") - 1) * rows + 1, F.col("total_rows")).alias("first_row"),
        F.least(F.col("page_no") * rows, F.col("total_rows")).alias("last_row"),
    )


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = SEED) -> DataFrame:
    """Seeded sample of ``n`` rows: those with the smallest key hashes. All rows if there are fewer.

    The cut-off hash is an exact order statistic, so the sample is one filter over the table.
    ``keys`` should identify a row; copies of one key enter or stay out together.
    """
    value = seeded_hash(seed, *[F.col(k) for k in keys])
    total = non_null_counts(df, {"h": value})["h"]
    if total <= n:
        return df
    cut = order_statistics(df, {"h": value}, {"h": [n - 1]}, {"h": total})["h"][n - 1]
    return df.filter(value <= cut)


def release_markers(months: DataFrame, month: str = "first_seen_month", limit: int = RELEASE_LABELS_MAX):
    """All distinct release months; with more than ``limit`` of them, every second one is ``labelled``.

    Works on one row per month, so the single ordered window stays as small as the calendar.
    """
    order = Window.orderBy(month)
    everything = Window.partitionBy()
    index, count = F.row_number().over(order), F.count(F.lit(1)).over(everything)
    return months.select(month).distinct().withColumn("labelled", (count <= limit) | (index % 2 == 1))
