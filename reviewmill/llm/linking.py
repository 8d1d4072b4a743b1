"""Groups of linked rows: candidates that share a key, verified, and connected components.

A key may be shared by a large part of all rows, so its rows are never paired with each other outright.
First every row is compared with one leader. Then, round by round, under keys that still hold several
components every row meets one row of the largest of those, another one each time; rounds end when
one of them links few more. Rows of a key that are still in different components are then all compared, or, if the
caller knows their sets, matched by rare members (``rare_matches``). No pair is left out. All joins are plain
sort-merge joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage, release_shuffles, write_stage


WORTHWHILE = 0.02  # share of the undecided rows that a cheap round must link for another one to follow
PAIRS_PER_ROW = 2  # pairs that are verified at once, per row that shares a key


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the smallest vertex it knows, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return linked.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``label``, its smallest reachable vertex, for every vertex of ``edges`` (``a``, ``b``).

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    named = followers(edges)
    return named.unionByName(named.select(F.col("label").alias("v"), "label").distinct())


def followers(edges: DataFrame) -> DataFrame:
    """As ``components``, but without the vertices that are their own label.

    Large-star and small-star steps alternate until nothing changes; each round ends in a checkpoint.
    """
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _fingerprint(links)
    while before[0]:
        links = cut_lineage(small_star(large_star(links)))
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("v"), F.col("b").alias("label"))


def _similar(pairs: DataFrame, nodes: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs whose sketches pass ``near``."""
    left = nodes.select(F.col("id").alias("a"), F.col("sketch").alias("_sa"))
    right = nodes.select(F.col("id").alias("b"), F.col("sketch").alias("_sb"))
    return pairs.join(right, "b").join(left, "a").filter(near(F.col("_sa"), F.col("_sb"))).select("a", "b")


def linked_components(
    keys: DataFrame,
    near: Callable[[Column, Column], Column],
    verifier: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
    crossing: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``v`` and ``label`` of all rows linked to a smaller one; a row that is missing is its own label.

    ``keys`` has ``id`` and ``key``, several per id, rows may repeat. ``verifier`` gets the ids that share any key and returns their
    ``id`` and ``sketch`` and a function that keeps the true links among distinct pairs (``a``, ``b``). ``crossing`` gets
    what is undecided in the end (``key``, ``id``, ``label``, ``sketch``) and returns the pairs to verify, all of a key by default.
    """
    keys = keys.repartition("key")  # dealt once, for the aggregate and for the join with it
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").drop("last")
    members = write_stage(keys.join(shared, "key").distinct(), "members")
    release_shuffles(keys.sparkSession)
    nodes, verify = verifier(members.select("id").distinct())
    # one pair per row first: with the leader it meets under most of its keys
    offers = members.filter("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = offers.groupBy("id").agg(F.max(F.struct("n", (-F.col("leader")).alias("leader"))).alias("best"))
    first = best.select((-F.col("best.leader")).alias("a"), F.col("id").alias("b"))

    rows = nodes.count()

    def links(pairs: DataFrame) -> DataFrame:
        """True links among pairs, all of them, verified in parts of a few pairs per row: disk for a part grows with the rows, not the pairs.

        Pairs are written first, so that the shuffles that made them go before what they compare is dealt.
        """
        pairs = write_stage(pairs, "pairs")
        parts = max(1, -(-pairs.count() // (PAIRS_PER_ROW * max(1, rows))))
        release_shuffles(pairs.sparkSession)
        linked = []
        for part in range(parts):  # by the first id: a row is the first of fewer pairs than there are rows
            some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == part) if parts > 1 else pairs
            linked.append(write_stage(verify(some), "links"))
            release_shuffles(pairs.sparkSession)
        return reduce(DataFrame.unionByName, linked)

    found = links(_similar(first, nodes, near))
    labels = followers(found)
    turn, worthwhile = 0, True
    while True:
        rest = _undecided(members, labels, nodes)
        if rest.isEmpty():
            return labels
        # every row with one of the largest component under its key; in the end, all that is left with all
        pairs = _similar(_to_largest(rest, turn), nodes, near) if worthwhile else crossing(rest) if crossing else _crossing(rest, near)
        more = links(pairs)
        gained = more.count()
        if gained:
            found = found.unionByName(more)
            labels = followers(found)
        if not worthwhile:
            return labels
        worthwhile = gained > WORTHWHILE * rest.select("id").distinct().count()
        turn += 1


def _undecided(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of keys that hold more than one component: ``key``, ``id``, ``label``, ``sketch``."""
    placed = members.join(labels.withColumnRenamed("v", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    rest = placed.join(split.select("key"), "key").join(nodes.select("id", "sketch"), "id")
    rest = write_stage(rest.select("key", "id", "label", "sketch"), "rest")
    release_shuffles(rest.sparkSession)
    return rest


def _to_largest(rest: DataFrame, turn: int) -> DataFrame:
    """Each row of a key with one row of the key's largest component, chosen by a hash that changes with ``turn``."""
    drawn = F.struct(F.xxhash64("id", F.lit(turn)).alias("drawn"), "id")
    held = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("low"))
    chosen = held.groupBy("key").agg(F.max(F.struct("n", "label", F.col("low.id").alias("other"))).alias("top"))
    pairs = rest.join(chosen, "key").filter(F.col("label") != F.col("top.label"))
    return pairs.select(F.least("id", "top.other").alias("a"), F.greatest("id", "top.other").alias("b")).distinct()


def _crossing(rest: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs of one key in different components whose sketches pass."""
    other = rest.select("key", F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("sketch").alias("sketch_b"))
    crossing = (
        (rest["key"] == other["key"]) & (rest["id"] < other["b"]) & (rest["label"] != other["label_b"])
        & near(rest["sketch"], other["sketch_b"])
    )
    return rest.join(other, crossing).select(F.col("id").alias("a"), "b").distinct()


def rare_matches(rest: DataFrame, features: DataFrame, percent: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of different labels that may reach ``percent`` of Jaccard similarity, by their rarest members.

    ``features`` has ``id``, ``set`` (an id may have several), ``size`` (of the whole set) and ``feature`` for all ids of ``rest``. With all sets in one order, rarest
    first, two similar sets meet within the first quarter or so of the larger one and the first seventh of the
    smaller one (at 75 %), and what follows their first common member must hold the whole intersection. Rows that
    share a passage but have texts of their own meet under none of their rare members. No similar pair is lost.
    """
    sharing = features.groupBy("feature").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id", "set").orderBy("often", "feature")
    placed = features.join(sharing, "feature").withColumn("at", F.row_number().over(order))
    # 100 * common >= percent * union; the larger set needs percent of its own size, the smaller one at least 2p / (100 + p)
    probe = placed.filter((F.col("often") > 1) & (F.lit(100) * (F.col("size") - F.col("at") + 1) >= F.lit(percent) * F.col("size")))
    about = rest.select("id", "label", "sketch").distinct()
    held = write_stage(probe.join(about, "id").select("feature", "id", "label", "sketch", "size", "at"), "rare")
    index = held.filter(F.lit(100 + percent) * (F.col("size") - F.col("at") + 1) >= F.lit(2 * percent) * F.col("size"))
    small = index.select("feature", *[F.col(c).alias(f"{c}_s") for c in ("id", "label", "sketch", "size", "at")])
    large = held.select("feature", *[F.col(c).alias(f"{c}_l") for c in ("id", "label", "sketch", "size", "at")])
    follows = F.least(F.col("size_s") - F.col("at_s"), F.col("size_l") - F.col("at_l")) + 1
    may = (
        (small["feature"] == large["feature"])
        & ((F.col("size_s") < F.col("size_l")) | ((F.col("size_s") == F.col("size_l")) & (F.col("id_s") < F.col("id_l"))))
        & (F.col("label_s") != F.col("label_l"))
        & (F.lit(100 + percent) * follows >= F.lit(percent) * (F.col("size_s") + F.col("size_l")))
        & near(F.col("sketch_s"), F.col("sketch_l"))
    )
    return small.join(large, may).select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b")).distinct()
