"""Bring review sources into one schema and combine them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import (
    CLEANED_COLUMNS,
    COLUMN_SYNONYMS,
    PLACEHOLDER_USERS,
    REVIEW_COLUMNS,
    SCRAPE_COLUMNS,
    TARGET_FRAGMENTS,
)
from reviewmill.functions.casts import to_datetime, to_number
from reviewmill.functions.text import strip_space
from reviewmill.operators.ordering import with_row_index


def resolve_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """First column whose lower-cased name is a candidate."""
    wanted = set(candidates)
    match = next((c for c in df.columns if c.lower() in wanted), None)
    if match is None and required:
        raise ValueError(f"none of the columns {df.columns} is one of {candidates}")
    return match


def resolve_target(df: DataFrame, fragments: list[str] | None = None) -> str:
    """First column whose lower-cased name contains a fragment."""
    fragments = fragments or TARGET_FRAGMENTS
    for name in df.columns:
        if any(part in name.lower() for part in fragments):
            return name
    raise ValueError(f"no target column among {df.columns}")


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer and floating columns; booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def harmonize_columns(df: DataFrame, source_name: str) -> DataFrame:
    """Project any source onto the canonical eight columns, in one select.

    Several raw columns may map to one name; they are coalesced in column order.
    """

    def typed(target: str) -> Column:
        parts = []
        for f in df.schema.fields:
            if f.name.lower() not in COLUMN_SYNONYMS[target]:
                continue
            raw = F.col(f"`{f.name}`")
            if target in ("score", "thumbs_up"):
                parts.append(to_number(raw, f.dataType))
            elif target == "created_at":
                parts.append(to_datetime(raw, f.dataType))
            else:
                parts.append(raw.cast("string"))
        if parts:
            return F.coalesce(*parts)
        kind = {"score": "double", "thumbs_up": "double", "created_at": "timestamp_ntz"}
        return F.lit(None).cast(kind.get(target, "string"))

    columns = [typed(name).alias(name) for name in REVIEW_COLUMNS if name != "source"]
    return df.select(*columns, F.lit(source_name).alias("source"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union all, by name; copies are kept."""
    return reduce(DataFrame.unionByName, frames)


def project_scrape_columns(df: DataFrame) -> DataFrame:
    return df.select(*SCRAPE_COLUMNS)


def project_final_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in CLEANED_COLUMNS if c in df.columns])


def add_constant_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def is_placeholder_user(user: Column) -> Column:
    return user.isNull() | F.lower(strip_space(user)).isin(PLACEHOLDER_USERS)


def fill_anonymous_user(df: DataFrame) -> DataFrame:
    """Replace missing and placeholder users by ``anon_<review_id>``.

    Rows without a review id get ``anon_idx_<n>``, where n is their rank among such rows by
    (source, created_at, content). Only these rows are sorted; all others are a projection.
    """
    bad = is_placeholder_user(F.col("user"))
    unknown = bad & F.col("review_id").isNull()
    named = df.filter(~unknown).withColumn(
        "user", F.when(bad, F.concat(F.lit("anon_"), "review_id")).otherwise(F.col("user"))
    )
    order = [F.col(c).asc_nulls_first() for c in ("source", "created_at", "content")]
    ranked = with_row_index(df.filter(unknown), order, "_rank")
    indexed = ranked.withColumn("user", F.concat(F.lit("anon_idx_"), F.col("_rank"))).drop("_rank")
    return named.unionByName(indexed.select(*df.columns))
