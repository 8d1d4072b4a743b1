"""Imputation and scaling: a small fitted value per column, applied as a projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.order_stats import exact_medians


@dataclass(frozen=True)
class MedianImputer:
    medians: dict[str, float | None]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> MedianImputer:
        return cls(exact_medians(train, columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double"))
                for c, m in self.medians.items()
            }
        )


@dataclass(frozen=True)
class LinearScaler:
    """(x - shift) / width per column, with width 1 for a constant column."""

    kind: str
    shift: dict[str, float]
    width: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], kind: str = "standard") -> LinearScaler:
        def pair(c: str) -> tuple[Column, Column]:
            x = F.col(c).cast("double")
            if kind == "standard":
                return F.avg(x), F.stddev_pop(x)
            return F.min(x), F.max(x) - F.min(x)

        stats = [p.alias(f"{side}{i}") for i, c in enumerate(columns) for side, p in zip("sw", pair(c))]
        row = train.agg(*stats).first()
        shift = {c: row[f"s{i}"] for i, c in enumerate(columns)}
        width = {c: row[f"w{i}"] or 1.0 for i, c in enumerate(columns)}
        return cls(kind, shift, width)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c).cast("double") - self.shift[c]) / self.width[c] for c in self.shift}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.width[c] + self.shift[c] for c in self.shift})
