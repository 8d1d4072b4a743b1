"""Seeded splits. Cut-offs are exact order statistics of a key hash; tagging rows is a projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.constants import REGRESSION_TEST_SHARE, SEED, TEST_SHARE, VALIDATION_SHARE
from reviewmill.functions.reviews import seeded_hash
from reviewmill.operators.order_stats import non_null_counts, order_statistics


def allocate(counts: dict[str, int], draws: int) -> dict[str, int]:
    """Share ``draws`` over classes in proportion, largest remainder first, then label order."""
    total = sum(counts.values())
    exact = {label: n * draws / total for label, n in counts.items()}
    given = {label: math.floor(x) for label, x in exact.items()}
    by_rest = sorted(counts, key=lambda label: (-(exact[label] - given[label]), label))
    for label in by_rest[: draws - sum(given.values())]:
        given[label] += 1
    return given


def split_sizes(
    counts: dict[str, int], test: float = TEST_SHARE, val: float = VALIDATION_SHARE
) -> dict[str, tuple[int, int]]:
    """label -> (test rows, validation rows)."""
    total = sum(counts.values())
    rest_total = total - math.ceil(test * total)
    rest = allocate(counts, rest_total)
    train = allocate(rest, rest_total - math.ceil(val * rest_total))
    return {label: (n - rest[label], rest[label] - train[label]) for label, n in counts.items()}


def _tag(h: Column, cuts: list[tuple[float | None, str]], last: str) -> Column:
    tag = F.lit(last)
    for cut, name in reversed(cuts):
        if cut is not None:
            tag = F.when(h <= cut, name).otherwise(tag)
    return tag


def stratified_split(
    df: DataFrame,
    label: str,
    keys: list[str],
    test: float = TEST_SHARE,
    val: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``dataset`` (train, val, test) with per-label proportional sizes.

    Copies of one key always land in the same part, so nothing leaks between parts.
    """
    h = seeded_hash(seed, *[F.col(k) for k in keys])
    labelled = df.filter(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}  # classes
    if not counts:
        return labelled.withColumn("dataset", F.lit("train"))
    sizes = split_sizes(counts, test, val)
    columns = {str(c): F.when(F.col(label) == c, h) for c in counts}
    ranks = {str(c): [t - 1, t + v - 1] for c, (t, v) in sizes.items()}
    found = order_statistics(labelled, columns, ranks, {str(c): n for c, n in counts.items()})
    tag = None
    for c, (t, v) in sizes.items():
        cuts = [(found[str(c)].get(t - 1), "test"), (found[str(c)].get(t + v - 1), "val")]
        here = _tag(h, cuts, "train")
        tag = F.when(F.col(label) == c, here) if tag is None else tag.when(F.col(label) == c, here)
    return labelled.withColumn("dataset", tag)


def random_split(
    df: DataFrame, keys: list[str], test: float = REGRESSION_TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``dataset`` (train, test); the test part has ceil(test * rows) rows."""
    h = seeded_hash(seed, *[F.col(k) for k in keys])
    total = non_null_counts(df, {"h": h})["h"]
    rank = math.ceil(test * total) - 1
    cut = order_statistics(df, {"h": h}, {"h": [rank]}, {"h": total})["h"].get(rank)
    return df.withColumn("dataset", _tag(h, [(cut, "test")], "train"))


def split_class_balance(df: DataFrame, label: str) -> DataFrame:
    """Label share per part; the window runs over (part, label) counts only."""
    counts = df.groupBy("dataset", label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("dataset"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def union_splits(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    parts = [d.withColumn("dataset", F.lit(t)) for d, t in ((train, "train"), (val, "val"), (test, "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
