"""Row filters and null handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.reviews import score_group
from reviewmill.functions.text import has_text


def drop_blank_content(df: DataFrame, col: str = "content") -> DataFrame:
    """Keep rows whose text has at least one visible character."""
    return df.filter(F.col(col).isNotNull() & has_text(F.col(col)))


def blank_content_report(df: DataFrame, col: str = "content") -> DataFrame:
    """Rows before, removed and kept by :func:`drop_blank_content`, in one pass."""
    kept = F.count_if(F.col(col).isNotNull() & has_text(F.col(col)))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after")).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, "rows_before").alias(
            "removed_pct"
        ),
    )


def fill_zero(df: DataFrame, col: str = "thumbs_up") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0).cast(df.schema[col].dataType)))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns)


def split_low_high(df: DataFrame, score: str = "score") -> DataFrame:
    """Tag rows ``low`` or ``high`` and drop the rest: one pass instead of two filtered copies."""
    kept = df.filter((F.col(score) <= 2) | (F.col(score) == 5))
    return kept.withColumn("score_group", score_group(F.col(score)))
