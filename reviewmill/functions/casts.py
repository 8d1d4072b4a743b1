"""Tolerant casts: a value that cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import CSV_NULL_TOKENS

# What a tolerant number parser accepts; hex, digit separators and type suffixes are not numbers.
NUMBER_PATTERN = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
DATE_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:[ T].*)?$"
OTHER_DATE_FORMATS = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]


def tokens_to_null(col: Column, tokens: list[str] | None = None) -> Column:
    """NULL for every token that stands for a missing CSV value."""
    return F.when(~col.isin(CSV_NULL_TOKENS if tokens is None else tokens), col)


def nan_to_null(col: Column) -> Column:
    """NaN is a value in Spark but means missing here; aggregates must skip it."""
    return F.when(~F.isnan(col), col)


def to_number(col: Column, dtype: T.DataType | None = None) -> Column:
    """Double or NULL. ``dtype`` is the input type; strings are assumed when it is absent."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return nan_to_null(col.cast("double"))
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            return col.cast("double")
        return F.lit(None).cast("double")
    return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))


def to_datetime(col: Column, dtype: T.DataType | None = None) -> Column:
    """Zone-less timestamp or NULL. Integers are read as epoch nanoseconds."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        return F.timestamp_micros((col / 1000).cast("bigint")).cast("timestamp_ntz")
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("timestamp_ntz")
    text = F.trim(col)
    iso = F.when(col.rlike(DATE_PATTERN), text.try_cast("timestamp_ntz"))
    others = [
        F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in OTHER_DATE_FORMATS
    ]
    return F.coalesce(iso, *others)
