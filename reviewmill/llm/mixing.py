"""Mix sources to target weights by systematic sampling.

Every source gets a target number of words. Each of its documents is expected ``target / source size`` times in
the mix; a prefix sum of these expected copies runs through the source, and with one random offset per source a
document is emitted once per integer that its stretch of the sum crosses. Documents are summed in order of size,
so what one leaves out the next one of like size takes, and the words taken stay within about one document of the
target. Expected copies are fixed-point numbers, so sums are exact and do not depend on how rows are split.

Nothing is gathered by source: rows are sorted over all tasks by (source, size), each task adds up its own
stretch, and only one partial sum per task travels through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import put_columns, with_schema
from reviewmill.operators.lookup import lookup_join
from reviewmill.operators.ordering import with_row_index
from reviewmill.session import cut_lineage, write_stage

WEIGHTS = (5, 2, 1)  # of the sources in order of their names, repeating
SHARE = (3, 2)  # the mix has three halves of all words
MOST = 2  # times a source may be repeated
SEED = 12
ONE = 52  # binary digits after the point of expected copies
WORD = r"[^\x20\x09-\x0D]++"
ADDED = ("size", "source_size", "target", "copies")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """Target words per source from ``source, source_size``: the share by weight, ``most`` times the size at most.

    Weights go round by code point order of the names, NULL last. What a full source cannot take is shared among
    the others by weight until none is above its limit. That level only rises, so each round is one aggregate over
    the sources with the level of the round before, in whole numbers.
    """
    ranked = with_row_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight.cast("bigint")))

    def exact(c):
        return F.col(c).cast("decimal(20,0)")

    up, down = share
    sums = ranked.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).head()
    total, rest, full = int(sums[0] or 0), int(sums[1] or 0), 0
    while True:  # level = (total * up / down - most * full) / rest words per unit of weight
        height, width = up * total - most * down * full, down * rest
        is_full = F.lit(most) * exact("source_size") * F.lit(Decimal(width)) < exact("weight") * F.lit(Decimal(height))
        if not rest:
            break
        found = ranked.agg(
            F.sum(F.when(is_full, exact("source_size"))), F.sum(F.when(is_full, F.lit(None)).otherwise(exact("weight")))
        ).head()
        now = int(found[0] or 0), int(found[1] or 0)
        if now == (full, rest) or not now[1]:
            break
        full, rest = now
    target = F.when(is_full, (most * F.col("source_size")).cast("double")).otherwise(
        (exact("weight") * F.lit(Decimal(height))).cast("double") / F.lit(float(max(width, 1)))
    )
    return ranked.withColumn("target", target)


def _running(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch of sorted rows with its ranks, expected copies, and their sum within the source up to each row.

    ``start`` is the sum of the first row's source in earlier tasks. Sums wrap around at 4,096 copies.
    """
    at, rank = np.array([start], np.uint64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        ranks = batch.column("rank").to_numpy(zero_copy_only=False)
        step = batch.column("expected").to_numpy(zero_copy_only=False).astype(np.uint64)
        new = np.r_[rank is not None and ranks[0] != rank, ranks[1:] != ranks[:-1]]
        run = np.cumsum(step, dtype=np.uint64)
        until = run - np.concatenate([np.zeros(1, np.uint64) - at, (run - step)[new]])[np.cumsum(new)]
        at, rank = until[-1:], ranks[-1]
        yield batch, ranks, step, until


_EDGES = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("sum", pa.decimal128(20, 0))])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: its first and last source, and the sum within the last."""
    first = last = None
    for _, ranks, _, until in _running(batches, 0):
        first = int(ranks[0]) if first is None else first
        last = int(ranks[-1]), int(until[-1])
    if last:
        yield pa.RecordBatch.from_pydict(
            {"part": [TaskContext.get().partitionId()], "first": [first], "last": [last[0]], "sum": [Decimal(last[1])]}, _EDGES
        )


def systematic_copies(df: DataFrame, order: list[Column], name: str = "copies") -> DataFrame:
    """Add how often each row is emitted.

    ``rank`` is the source's number, ``expected`` the copies expected of a row and ``offset`` the source's random
    offset, both with ``ONE`` binary digits after the point. Rows are summed in ``order`` within their source; an
    extra last key spreads rows that are equal in it.
    """
    fixed = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()).orderBy("rank", *order, "_id").drop("_id"))
    starts, rank, total = {}, None, 0
    edges = fixed.select("rank", "expected").mapInArrow(_edges, "part bigint, first bigint, last bigint, sum decimal(20,0)")
    for row in sorted(edges.collect(), key=lambda r: r["part"]):  # one row per task
        starts[row["part"]] = total if row["first"] == rank else 0
        total = (int(row["sum"]) + (starts[row["part"]] if row["first"] == row["last"] else 0)) % (1 << 64)
        rank = row["last"]

    def emit(batches):
        for batch, _, step, until in _running(batches, starts.get(TaskContext.get().partitionId(), 0)):
            until = until + batch.column("offset").to_numpy(zero_copy_only=False).astype(np.uint64)
            copies = ((until >> np.uint64(ONE)) - ((until - step) >> np.uint64(ONE))) & np.uint64((1 << (64 - ONE)) - 1)
            yield put_columns(batch, {name: pa.array(copies.astype(np.int64))})

    return fixed.mapInArrow(emit, with_schema(fixed, **{name: "bigint"}))


def _seeded(*parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", with_text: bool = True, **rules) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` (both of the source) and ``copies`` to every document.

    NULL text has no words; NULL is a source of its own. A source without words has target 0 and its documents no
    copies. Documents of one source are summed by size, then by a hash of key and text, so reruns agree; rows that
    are equal in all of these are interchangeable unless other columns differ. A column of ``docs`` with the name
    of an added one is replaced. An empty table stays empty. Without ``with_text`` no text is written or moved.
    ``rules`` go to ``source_targets``.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    tie = F.substring(_seeded(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 1, 12)
    kept = [c for c in docs.columns if c not in ADDED and (with_text or c != text)]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in kept],
        F.col(f"`{source}`").cast("string").alias("source"),
        words.alias("size"),
        tie.alias("tie"),
        F.xxhash64(f"`{text}`").alias("tie2"),
    )
    rows = write_stage(rows, "mixing")  # words are counted once, not again for each sort and sum
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, **rules)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double") * float(1 << ONE)).otherwise(0.0)
    offset = F.substring(_seeded(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 1, ONE // 4)
    targets = targets.select(
        "source", "rank", "source_size", "target", F.floor(rate).cast("bigint").alias("expected"), F.conv(offset, 16, 10).cast("bigint").alias("offset")
    )
    joined = lookup_join(rows, targets, {"source": "source"}).drop("source")
    copied = systematic_copies(joined, [F.col("size"), F.col("tie"), F.col(names[key]), F.col("tie2")])
    return copied.select(*[F.col(names[c]).alias(c) for c in kept], *ADDED)


def repeat_rows(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Every row as often as its copies say."""
    wanted = mixed.filter(F.col(copies) > 0)
    again = F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias("_again")
    return wanted.select(*[F.col(f"`{c}`") for c in mixed.columns], again).drop("_again")
