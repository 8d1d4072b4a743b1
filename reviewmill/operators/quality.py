"""Data quality and descriptive tables. All per-column figures come from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.constants import CAP_QUANTILE, VERY_LONG_QUANTILE, VERY_SHORT_CHARS
from reviewmill.functions.reviews import histogram_bar, whole_days
from reviewmill.operators.order_stats import exact_quantiles


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def missing_counts(df: DataFrame) -> DataFrame:
    """column, missing, total: one row per column, from a single scan."""
    row = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    return row.unpivot(["_total"], df.columns, "column_name", "missing").withColumnRenamed(
        "_total", "total"
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns that have missing values, most affected first."""
    return (
        missing_counts(df)
        .filter(F.col("missing") > 0)
        .select("column_name", "missing", _pct(F.col("missing"), F.col("total")).alias("missing_pct"))
        .orderBy(F.col("missing").desc(), "column_name")
    )


def missing_total(df: DataFrame) -> DataFrame:
    return missing_counts(df).agg(F.sum("missing").alias("missing_total"))


def missing_for_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = missing_counts(df.select(*columns))
    return counts.select(
        "column_name", "missing", _pct(F.col("missing"), F.col("total")).alias("missing_pct")
    )


def share_table(df: DataFrame, col: str, skip_null: bool = True) -> DataFrame:
    """count and percent per value. NULL gets no row but stays in the denominator.

    The total is a bare row count, which a Parquet table answers from its footers.
    """
    grouped = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    shares = grouped.withColumn("pct", _pct(F.col("n"), df.agg(F.count(F.lit(1))).scalar()))
    return shares.filter(F.col(col).isNotNull()) if skip_null else shares


def source_distribution(df: DataFrame) -> DataFrame:
    return share_table(df, "source").orderBy(F.col("n").desc(), "source")


def rating_distribution(df: DataFrame, score: str = "score") -> DataFrame:
    shares = share_table(df, score)
    return shares.withColumn("bar", histogram_bar(F.col("pct"))).orderBy(score)


def yearly_distribution(df: DataFrame, ts: str = "created_at") -> DataFrame:
    years = df.select(F.year(ts).alias("year"))
    return share_table(years, "year").orderBy("year")


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """Mode, smallest value on ties, as a top-1 over counts instead of one big buffer."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(col)).limit(1).select(F.col(col).alias("mode"))


def rating_stats(df: DataFrame, score: str = "score") -> DataFrame:
    median = exact_quantiles(df, {"m": F.col(score)}, [0.5])["m"][0]
    row = df.agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return row.select(
        "mean",
        F.lit(median).cast("double").alias("median"),
        most_frequent(df, score).scalar().alias("mode"),
        "std",
    )


def length_stats(df: DataFrame, col: str = "content", measured: str = "content_len") -> DataFrame:
    """Lengths of the text; a table without it has them as ``measured``."""
    length = F.length(col) if col in df.columns else F.col(measured)
    median = exact_quantiles(df, {"m": length}, [0.5])["m"][0]
    return df.agg(
        F.min(length).alias("min_len"),
        F.avg(length).alias("mean_len"),
        F.lit(median).cast("double").alias("median_len"),
        F.max(length).alias("max_len"),
        F.stddev_samp(length).alias("std_len"),
    )


def quantile_row(df: DataFrame, col: str, probs: dict[str, float], exact: bool = True) -> DataFrame:
    """One row with one named quantile per column; ``exact=False`` trades accuracy for one scan."""
    if not exact:
        approx = F.percentile_approx(F.col(col).cast("double"), list(probs.values()), 100_000)
        row = df.agg(approx.alias("q"))
        return row.select(*[F.col("q")[i].alias(name) for i, name in enumerate(probs)])
    values = exact_quantiles(df, {col: F.col(col)}, list(probs.values()))[col]
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(v).cast("double").alias(n) for n, v in zip(probs, values)])


def thumbs_quantiles(df: DataFrame, col: str = "thumbs_up", exact: bool = True) -> DataFrame:
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return quantile_row(df, col, probs, exact)


def cap_at_quantile(
    df: DataFrame, col: str, out: str, q: float = CAP_QUANTILE, fit_on: DataFrame | None = None
) -> DataFrame:
    """``least(col, quantile)`` as double. ``fit_on`` takes the threshold from another table."""
    cap = exact_quantiles(df if fit_on is None else fit_on, {col: F.col(col)}, [q])[col][0]
    value = F.col(col).cast("double")
    return df.withColumn(out, F.when(value.isNotNull(), F.least(value, F.lit(cap).cast("double"))))


def flag_very_long(
    df: DataFrame, col: str = "content_len", out: str = "is_very_long", q: float = VERY_LONG_QUANTILE
) -> DataFrame:
    limit = exact_quantiles(df, {col: F.col(col)}, [q])[col][0]
    return df.withColumn(out, F.col(col) > F.lit(limit).cast("double"))


def very_short_share(df: DataFrame, col: str = "content", limit: int = VERY_SHORT_CHARS) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length(col) < limit).alias("very_short"))
    return row.select("very_short", _pct(F.col("very_short"), F.col("total")).alias("very_short_pct"))


def outlier_count(df: DataFrame, col: str = "thumbs_up", q: float = CAP_QUANTILE) -> DataFrame:
    cap = exact_quantiles(df, {col: F.col(col)}, [q])[col][0]
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(col) > F.lit(cap).cast("double")).alias("outliers"),
    )
    return row.select(
        F.lit(cap).cast("double").alias("threshold"),
        "outliers",
        _pct(F.col("outliers"), F.col("total")).alias("outlier_pct"),
    )


def column_range_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean per numeric column, from one aggregate."""
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(F.col(c).cast("double")).alias("min_value"),
            F.max(F.col(c).cast("double")).alias("max_value"),
            F.avg(F.col(c).cast("double")).alias("mean_value"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def date_coverage(df: DataFrame, ts: str = "created_at") -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(ts).alias("valid_dates"),
        F.min(ts).alias("first_date"),
        F.max(ts).alias("last_date"),
    )
    return row.select(
        "valid_dates",
        _pct(F.col("valid_dates"), F.col("total")).alias("valid_pct"),
        "first_date",
        "last_date",
        whole_days(F.col("first_date"), F.col("last_date")).alias("span_days"),
    )


def merge_summary(df: DataFrame) -> DataFrame:
    """Rows per source plus a total line."""
    grouped = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = grouped.agg(F.lit("total").alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return grouped.unionByName(total)


def quality_delta(before: DataFrame, after: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Before/after table: rows, missing values, duplicates and their change in percent.

    ``duplicates`` is a one-row table with column ``duplicates``, measured before removal.
    """

    def size(df: DataFrame) -> DataFrame:
        nulls = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns), F.lit(0))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"))

    sides = size(before).select(F.lit("before").alias("side"), "*").unionByName(
        size(after).select(F.lit("after").alias("side"), "*")
    )
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    one = sides.agg(
        pick("before", "rows").alias("rows0"),
        pick("after", "rows").alias("rows1"),
        pick("before", "nulls").alias("nulls0"),
        pick("after", "nulls").alias("nulls1"),
    ).withColumn("dups", duplicates.select("duplicates").scalar())
    change = lambda a, b, base: F.try_divide((b - a) * 100.0, base)
    lines = F.array(
        F.struct(
            F.lit("rows").alias("metric"),
            F.col("rows0").alias("before"),
            F.col("rows1").alias("after"),
            change(F.col("rows0"), F.col("rows1"), F.col("rows0")).alias("change_pct"),
        ),
        F.struct(
            F.lit("missing").alias("metric"),
            F.col("nulls0").alias("before"),
            F.col("nulls1").alias("after"),
            change(F.col("nulls0"), F.col("nulls1"), F.greatest("nulls0", F.lit(1))).alias("change_pct"),
        ),
        F.struct(
            F.lit("duplicates").alias("metric"),
            F.col("dups").alias("before"),
            F.lit(0).cast("bigint").alias("after"),
            F.lit(-100.0).alias("change_pct"),
        ),
    )
    return one.select(F.inline(lines))


def clean_examples(df: DataFrame, before: str, after: str, order_by: list, rows: int | None = 3) -> DataFrame:
    """Among the first ``rows`` rows, or all of them: pairs that cleaning changed, originals under 100 characters."""
    first = df if rows is None else df.orderBy(*order_by).limit(rows)
    changed = (F.col(before) != F.col(after)) & (F.length(before) < 100)
    return first.filter(changed).select(
        F.substring(before, 1, 80).alias("before"), F.substring(after, 1, 80).alias("after")
    )
