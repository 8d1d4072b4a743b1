"""Categorical encoders and label codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import MISSING_CATEGORY, ONE_HOT_MAX_CATEGORIES
from reviewmill.operators.lookup import lookup_join
from reviewmill.operators.ordering import with_row_index

SORTED_LABELS = 1_000  # up to this many labels are numbered on the driver


def cardinality(df: DataFrame, columns: list[str], limit: int = ONE_HOT_MAX_CATEGORIES) -> DataFrame:
    """Distinct non-null values per column and the encoder they call for."""
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    long = row.unpivot([], columns, "column_name", "n_distinct")
    return long.withColumn(
        "encoder", F.when(F.col("n_distinct") <= limit, "one_hot").otherwise("frequency")
    )


@dataclass(frozen=True)
class OneHotEncoder:
    """Categories come from the training part; unknown values get zeros in every column."""

    categories: dict[str, list[str]]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], limit: int = 1000) -> OneHotEncoder:
        found = {}
        for c in columns:
            value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))
            rows = train.select(value.alias("v")).distinct().limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"{c} has more than {limit} categories: use frequency_encode")
            found[c] = sorted(r["v"] for r in rows)
        return cls(found)

    def outputs(self) -> list[tuple[str, str]]:
        """(column, category) per output; a binary column keeps only its second category."""
        return [
            (c, v) for c, values in self.categories.items() for v in (values[1:] if len(values) == 2 else values)
        ]

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, v in self.outputs()]

    def transform(self, df: DataFrame) -> DataFrame:
        value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))
        return df.withColumns(
            {f"{c}_{v}": (value(c) == v).cast("double") for c, v in self.outputs()}
        )


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """value, share of rows; NULL counts as a value."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(F.col(col).alias("_value"), (F.col("_n") / total).alias(f"{col}_freq"))


def frequency_encode(df: DataFrame, col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``<col>_freq``; values unseen in ``fit_on`` get 0."""
    table = frequency_table(df if fit_on is None else fit_on, col)
    joined = lookup_join(df, table, {col: "_value"})
    return joined.withColumn(f"{col}_freq", F.coalesce(f"{col}_freq", F.lit(0.0)))


def label_codes(train: DataFrame, label: str) -> DataFrame:
    """label, code: position in sorted order."""
    labels = train.filter(F.col(label).isNotNull()).select(label).distinct()
    rows = labels.limit(SORTED_LABELS + 1).collect()
    if len(rows) > SORTED_LABELS:
        return with_row_index(labels, [F.col(label)], "code")
    codes = [(value, i) for i, value in enumerate(sorted(r[label] for r in rows))]
    schema = T.StructType([train.schema[label], T.StructField("code", T.LongType())])
    return train.sparkSession.createDataFrame(codes, schema)


def encode_labels(df: DataFrame, train: DataFrame, label: str, out: str = "label") -> DataFrame:
    """Numeric labels are cast to integer; others get their code in sorted order, unseen ones -1."""
    if isinstance(df.schema[label].dataType, T.NumericType):
        return df.withColumn(out, F.col(label).cast("bigint"))
    codes = label_codes(train, label).select(F.col(label).alias("_label"), F.col("code").alias(out))
    joined = lookup_join(df, codes, {label: "_label"})
    return joined.withColumn(out, F.coalesce(out, F.lit(-1).cast("bigint")))
