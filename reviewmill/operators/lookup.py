"""Left joins of a large table to a lookup table whose size is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

BROADCAST_ROWS = 200_000
SHARES = 10_000  # a key with more than one row in so many is spread; there are at most so many such keys


def lookup_join(df: DataFrame, table: DataFrame, on: dict[str, str], max_rows: int = BROADCAST_ROWS, shares: int = SHARES) -> DataFrame:
    """Null-safe left join of ``df`` to ``table`` with one row per key; ``on`` maps df to table names.

    Up to ``max_rows`` table rows are broadcast. A larger table is joined by a shuffle. A key that owns more
    than one in ``shares`` rows of ``df``, NULL included, is spread over as many sub-keys as it owns
    shares; the list of those keys has at most ``shares`` rows and is broadcast.
    """
    table = cut_lineage(table)  # counted and joined from the same rows, made once
    values = [c for c in table.columns if c not in on.values()]
    renamed = table.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())], *values)
    match = [F.col(left).eqNullSafe(F.col(f"_k{i}")) for i, left in enumerate(on)]
    if table.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(renamed), match, "left").select(*df.columns, *values)
    total = df.count()
    weights = df.groupBy(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(on)]).agg(F.count(F.lit(1)).alias("_n"))
    heavy = F.broadcast(
        cut_lineage(weights.filter(F.col("_n") * shares > total).withColumn("_salts", F.ceil(F.col("_n") * shares / total).cast("int")).drop("_n"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    hot_left = [F.col(left).eqNullSafe(F.col(f"_h{i}")) for i, left in enumerate(on)]
    hot_right = [F.col(f"_k{i}").eqNullSafe(F.col(f"_h{i}")) for i, _ in enumerate(on)]
    salted = df.join(heavy, hot_left, "left").withColumn("_salt", F.pmod(F.xxhash64(*df.columns), salts).cast("int"))
    copies = renamed.join(heavy, hot_right, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = copies.drop("_salts", *[f"_h{i}" for i, _ in enumerate(on)])
    match.append(F.col("_salt") == F.col("_copy"))
    return salted.join(copies, match, "left").select(*df.columns, *values)
