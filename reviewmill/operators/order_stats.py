"""Exact order statistics and quantiles without gathering a column in one task.

Spark's exact ``percentile`` keeps one counter per distinct value in a single buffer. That does
not hold for high-cardinality columns at scale, so here each wanted rank is enclosed by two
values taken from ``percentile_approx``; one aggregate then counts what lies below and inside.
The bracket shrinks by orders of magnitude per pass until few rows remain, and only those are
ranked, as (value, count) pairs. Every pass is one column-pruned scan with map-side combine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_ROWS = 1_000_000  # a bracket at or below this many rows is ranked directly
ACCURACY = 10_000


@dataclass
class _Bracket:
    """Open interval (low, high) known to hold the wanted ranks, with the rows below and inside."""

    name: str
    column: Column
    ranks: list[int]
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    slack: float = 2.0 / ACCURACY
    found: dict[int, float] = field(default_factory=dict)

    def member(self) -> Column:
        inside = self.column.isNotNull()
        if self.low is not None:
            inside &= self.column > self.low
        if self.high is not None:
            inside &= self.column < self.high
        return inside


def _shrink(df: DataFrame, brackets: list[_Bracket]) -> None:
    """One narrowing pass over all wide brackets: two aggregates, whatever their number.

    The two probe values are counted apart from the rows between them, so a value that owns many
    rows is recognised at once and the open interval always loses most of its rows.
    """
    probes = []
    for i, b in enumerate(brackets):
        first = (min(b.ranks) - b.below) / b.inside - b.slack
        last = (max(b.ranks) - b.below + 1) / b.inside + b.slack
        probs = [min(max(first, 0.0), 1.0), min(max(last, 0.0), 1.0)]
        values = F.when(b.member(), b.column)
        probes.append(F.percentile_approx(values, probs, ACCURACY).alias(f"q{i}"))
    edges = df.agg(*probes).first()
    counts = []
    for i, b in enumerate(brackets):
        low, high = edges[f"q{i}"]
        counts.append(F.count_if(b.member() & (b.column < low)).alias(f"under{i}"))
        counts.append(F.count_if(b.member() & (b.column == low)).alias(f"low{i}"))
        counts.append(F.count_if((b.column > low) & (b.column < high)).alias(f"mid{i}"))
        counts.append(F.count_if(b.member() & (b.column == high)).alias(f"high{i}"))
    row = df.agg(*counts).first()
    for i, b in enumerate(brackets):
        low, high = edges[f"q{i}"]
        at_low = b.below + row[f"under{i}"]
        middle = at_low + row[f"low{i}"]
        at_high = middle + row[f"mid{i}"]
        end = at_high + (row[f"high{i}"] if high > low else 0)
        if min(b.ranks) < at_low or max(b.ranks) >= end:
            b.slack *= 4  # the probe missed: look again, wider
            continue
        b.found.update({r: low for r in b.ranks if r < middle})
        b.found.update({r: high for r in b.ranks if r >= at_high})
        b.ranks = [r for r in b.ranks if middle <= r < at_high]
        b.low, b.high, b.below, b.inside = low, high, middle, row[f"mid{i}"]


def _rank_inside(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Rank the few remaining rows of every bracket as (value, count) pairs."""
    if not brackets:
        return
    tagged = F.array(
        *[
            F.struct(F.lit(i).alias("b"), F.when(b.member(), b.column).alias("v"))
            for i, b in enumerate(brackets)
        ]
    )
    pairs = (
        df.select(F.explode(tagged).alias("t"))
        .select("t.b", "t.v")
        .filter(F.col("v").isNotNull())
        .groupBy("b", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = pairs.withColumn("upto", F.sum("n").over(running))
    hit = F.lit(False)
    for i, b in enumerate(brackets):
        for rank in b.ranks:
            local = rank - b.below
            hit |= (F.col("b") == i) & (F.col("upto") > local) & (F.col("upto") - F.col("n") <= local)
    for row in ranked.filter(hit).collect():  # at most one row per wanted rank
        b = brackets[row["b"]]
        for rank in b.ranks:
            local = rank - b.below
            if row["upto"] > local >= row["upto"] - row["n"]:
                b.found[rank] = row["v"]


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, list[int]],
    counts: dict[str, int],
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ``ranks`` of each numeric column expression.

    ``counts`` holds the number of non-null values per column. Runs jobs; returns driver values,
    one per wanted rank.
    """
    brackets: list[_Bracket] = []
    for name, wanted in ranks.items():
        wanted = sorted({r for r in wanted if 0 <= r < counts[name]})
        if not wanted:
            continue
        column = columns[name].cast("double")
        if counts[name] <= RANK_ROWS:
            brackets.append(_Bracket(name, column, wanted, 0, counts[name]))
            continue
        group: list[int] = []
        for rank in wanted:  # ranks close together share one bracket
            if group and rank - group[0] > counts[name] / ACCURACY:
                brackets.append(_Bracket(name, column, group, 0, counts[name]))
                group = []
            group = [*group, rank]
        brackets.append(_Bracket(name, column, group, 0, counts[name]))
    while wide := [b for b in brackets if b.ranks and b.inside > RANK_ROWS]:
        _shrink(df, wide)
    _rank_inside(df, [b for b in brackets if b.ranks])
    result: dict[str, dict[int, float]] = {name: {} for name in ranks}
    for b in brackets:
        result[b.name].update(b.found)
    return result


def non_null_counts(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(column).alias(name) for name, column in columns.items()]).first()
    return {name: row[name] for name in columns}


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float]
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, ``None`` for a column without values."""
    columns = {name: column.cast("double") for name, column in columns.items()}
    counts = non_null_counts(df, columns)
    spots = {
        name: [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1)) for p in probs]
        for name, n in counts.items()
        if n
    }
    ranks = {name: [r for low, high, _ in at for r in (low, high)] for name, at in spots.items()}
    values = order_statistics(df, columns, ranks, counts)
    result: dict[str, list[float | None]] = {}
    for name in columns:
        if name not in spots:
            result[name] = [None] * len(probs)
            continue
        found = values[name]
        result[name] = [
            found[low] + (found[high] - found[low]) * (spot - low) for low, high, spot in spots[name]
        ]
    return result


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    found = exact_quantiles(df, {name: F.col(name) for name in columns}, [0.5])
    return {name: value[0] for name, value in found.items()}
