"""Near-duplicate documents: MinHash, banding, signature verification, exact verification, components.

Documents with the same set of word shingles are one node. A node's signature holds the minimum of its
shingle hashes under each of many universal hash functions; bands of it are the keys that bring
candidates together, a two-bit cut of it is the sketch that throws most false candidates out, and the
full sets decide. A pair at similarity 0.75 shares no band with probability under one in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import doc_text, shielded, texts
from reviewmill.llm.linking import linked_components, rare_matches
from reviewmill.llm.measures import shingle_hashes, word_hashes
from reviewmill.session import write_stage

SHINGLE = 5
SIMILARITY_PERCENT = 75
BANDS = 32
ROWS = 4
_CHUNK = 1024


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts of the universal hash functions x -> a * x + b mod 2 ** 64."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]


_A, _B = _functions(BANDS * ROWS)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text with fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(words), min(size, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, (_A * shingles[at : at + _CHUNK] + _B).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band."""
    rows = least.reshape(BANDS, ROWS).copy()
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for step in range(ROWS):
        key = (key ^ rows[:, step]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, packed into signed 64-bit numbers."""
    bits = ((least >> np.uint64(7)) & np.uint64(3)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def near(a: Column, b: Column, percent: int = SIMILARITY_PERCENT) -> Column:
    """Whether two sketches may belong to similar sets: six deviations of room, so no link is lost here."""
    count = BANDS * ROWS
    rate = 0.75 * (1 - percent / 100)
    most = int(count * rate + 6 * (count * rate * (1 - rate)) ** 0.5)
    differing = F.lit(0)
    for at in range(count // 32):
        x = F.get(a, F.lit(at)).bitwiseXOR(F.get(b, F.lit(at)))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differing = differing + F.bit_count(either)
    return differing <= most


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sizes, prints, keys, cuts = [], [], [], []
            for text in texts(batch, "text"):
                found = shingle_set(text)
                least = signature(found)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(least) if len(found) else None)
                cuts.append(sketch(least) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(cuts, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "print", "keys", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            found = pa.array([shingle_set(t).tobytes() for t in texts(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["id", "shingles"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per member of a set."""
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            held = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in held], np.int64)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), sizes)
            sets = np.repeat(batch.column("set").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(held))],
                names=["id", "set", "size", "feature"],
            )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) < SIMILARITY_PERCENT * max(len(x), len(y)):
                good.append(False)
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * common >= SIMILARITY_PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents are linked if 100 times the intersection of their shingle sets is at least 75 times the
    union. ``component_id`` is the smallest doc_id reachable, ``kept`` marks that document. NULL and empty
    texts and texts without words have an empty set and are linked with nothing. A row without
    doc_id is linked with nothing: its component is NULL and it is kept. Rows that share a doc_id are judged
    each by its own text. An empty table gives an empty one.
    """
    described = write_stage(docs.select("doc_id", "text").mapInArrow(_describe, "doc_id bigint, n_shingles bigint, print binary, keys array<bigint>, sketch array<bigint>"), "signatures")
    named = described.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    # copies of a set are one node, the smallest of their ids; partial minima meet before the shuffle
    nodes = write_stage(
        named.groupBy("print").agg(F.min(F.struct("doc_id", "sketch", "keys")).alias("n")).select("print", F.col("n.doc_id").alias("id"), "n.sketch", "n.keys"),
        "nodes",
    )

    held: list[DataFrame] = []

    def verifier(wanted: DataFrame):
        # only documents that share a key with another are read as sets
        sets = write_stage(
            docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "id bigint, shingles binary"),
            "sets",
        )
        held.append(sets)

        def verify(pairs: DataFrame) -> DataFrame:
            left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
            right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
            return pairs.join(right, "b").join(left, "a").mapInArrow(_linked, "a bigint, b bigint").distinct()

        return nodes.select("id", "sketch"), verify

    def crossing(rest: DataFrame) -> DataFrame:
        open_sets = held[0].join(rest.select("id").distinct(), "id", "left_semi").withColumn("set", F.xxhash64("shingles")).dropDuplicates(["id", "set"])
        members = open_sets.mapInArrow(_members, "id bigint, set bigint, size bigint, feature bigint")
        return rare_matches(rest, members, SIMILARITY_PERCENT, near)

    labels = linked_components(nodes.select("id", F.explode("keys").alias("key")), near, verifier, crossing)
    classes = nodes.select("print", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").select(
        "print", F.coalesce("label", "id").alias("label")
    )
    placed = described.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    out = placed.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose document is kept, one document of each group, with all columns.

    A document whose rows differ in text goes only if none of them is kept; its rows stay as they are.
    """
    verdicts = near_duplicates(doc_text(df)).filter(F.col("doc_id").isNotNull())
    gone = verdicts.groupBy(F.col("doc_id").alias("gone")).agg(F.bool_or("kept").alias("any_kept")).filter("NOT any_kept")
    return shielded(df, lambda bare, names: bare.join(gone, F.col(names["doc_id"]) == F.col("gone"), "left_anti"))
