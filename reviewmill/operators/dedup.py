"""Newest-wins deduplication.

``row_number() <= 1`` lets Spark keep one row per key inside each map task before the shuffle, so
a key that owns a large share of the rows never meets in one task. Rows without an id are never
one group: user and text tell them apart, so none is lost to another review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.lookup import BROADCAST_ROWS
from reviewmill.operators.ordering import newest_first
from reviewmill.session import cut_lineage

TIES = ("content", "user", "app_version", "source", "score", "thumbs_up")


def _order(df: DataFrame, ts: str, ties: tuple[str, ...] | None) -> list[Column]:
    ties = TIES if ties is None else ties
    return newest_first(ts, *[t for t in ties if t in df.columns])


def _first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= 1).drop("_rn")


def _first_per_id(df: DataFrame, key: str, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """First row per id. Rows without id are told apart by user and text, or all kept where there is neither.

    One pass over ``df``; the rows without id spread over the shuffle by what tells them apart.
    """
    missing = F.col(key).isNull()
    keys = [*[F.col(name) for name in within], F.col(key)]
    if {"user", "content"} <= set(df.columns):
        return _first_per_key(df, [*keys, F.when(missing, F.col("user")), F.when(missing, F.col("content"))], order)
    alone = df.withColumn("_alone", F.when(missing, F.monotonically_increasing_id()))
    return _first_per_key(alone, [*keys, F.col("_alone")], order).drop("_alone")


def dedup_newest_by_id(
    df: DataFrame,
    key: str = "review_id",
    ts: str = "created_at",
    ties: tuple[str, ...] | None = None,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Newest row per id; rows without id are the newest per (user, content).

    ``within`` names columns that the id determines: rows already dealt by them are not shuffled again.
    """
    return _first_per_id(df, key, _order(df, ts, ties), within)


def newest_without_text(keyed: DataFrame) -> DataFrame:
    """The rows that :func:`dedup_newest_by_id` keeps of a written table, without their ``content``.

    ``keyed`` has ``_row``, a number of each row's own, and ``_digest`` of the text. Only the short columns are shuffled. Texts
    decide the order among rows of one id and time alone; where such rows differ in text, theirs are fetched and ranked.
    """
    facts = keyed.drop("content")
    at = ["review_id", "created_at"]
    named = facts.filter(F.col("review_id").isNotNull())
    apart = named.groupBy(*at).agg(F.min("_digest").alias("lo"), F.max("_digest").alias("hi")).filter("lo <> hi")
    same = [named[c].eqNullSafe(apart[c]) for c in at]
    tied = cut_lineage(named.join(apart, same, "left_semi").select("_row", *at))
    n = tied.count()
    place = F.lit(None).cast("int")
    if n:
        texts = keyed.select("_row", "content").join(F.broadcast(tied) if n <= BROADCAST_ROWS else tied.hint("shuffle_hash"), "_row")
        ranked = texts.select("_row", F.rank().over(Window.partitionBy(*at).orderBy("content")).alias("_place"))
        facts, place = facts.join(cut_lineage(ranked), "_row", "left"), F.col("_place")
    missing = F.col("review_id").isNull()
    keys = [F.col("review_id"), F.when(missing, F.col("user")), F.when(missing, F.col("_digest"))]
    order = newest_first("created_at")
    order += [place.asc_nulls_first() if c == "content" else F.col(c).asc_nulls_first() for c in TIES]
    return _first_per_key(facts, keys, order).drop("_place")


def dedup_newest_by_user_content(
    df: DataFrame, ts: str = "created_at", ties: tuple[str, ...] | None = None
) -> DataFrame:
    """Newest row per (user, content); NULLs are equal to each other."""
    return _first_per_key(df, [F.col("user"), F.col("content")], _order(df, ts, ties))


def dedup_first_by_id(df: DataFrame, order_by: list[Column], key: str = "review_id") -> DataFrame:
    """First row per id in an explicit fetch order; rows without id as in ``dedup_newest_by_id``."""
    return _first_per_id(df, key, order_by)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Ids beyond their first use; without any id, repeated (user, content) pairs.

    Both counts group first, so copies are combined before the shuffle.
    """
    ids = df.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    by_id = ids.agg(
        F.coalesce(F.sum(F.when(F.col("review_id").isNotNull(), F.col("n"))), F.lit(0)).alias("ids"),
        F.count("review_id").alias("unique_ids"),
    )
    if not df.filter(F.col("review_id").isNotNull()).isEmpty():
        return by_id.select("ids", "unique_ids", (F.col("ids") - F.col("unique_ids")).alias("duplicates"))
    pairs = df.groupBy("user", "content").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pairs")).select(
        F.lit(0).cast("bigint").alias("ids"),
        F.lit(0).cast("bigint").alias("unique_ids"),
        F.coalesce(F.col("rows") - F.col("pairs"), F.lit(0)).alias("duplicates"),
    )


def merge_newest(master: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Old master and new batch, newest row per id. Without a master the batch becomes it."""
    if master is None:
        return batch
    return dedup_newest_by_id(master.unionByName(batch))
