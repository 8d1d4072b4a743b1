"""Benchmark decontamination with suffix arrays over shards of the training text.

A task joins its documents to shards, sorts the suffixes of each shard and binary-searches every suffix
of the benchmark in them. Only suffixes that begin with words some benchmark suffix begins with can be
found, so only those are sorted. No row leaves its task: there is no shuffle. The benchmark is shared in
blocks of bounded size; a larger one takes several passes over the documents, whose state travels with
the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import put_columns, shielded, texts, with_schema

WINDOW = 13
SHARD_WORDS = 262_144
BLOCK_WORDS = 1_000_000
BITS = 21  # of a word number; three make a 63-bit key. BLOCK_WORDS stays below 2 ** BITS
_PER_KEY = 3
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_STATE = {"n_words": "bigint", "n_hit": "bigint", "hit_spans": "binary", "items": "array<string>", "matches": "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"}
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))


def split_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(_WORD_BYTES).split() if text else []


def _keys(numbers: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Fixed-width sort keys of the ``depth`` words from each start, as byte strings."""
    padded = np.concatenate([numbers, np.zeros(depth + _PER_KEY, np.int64)])
    columns = []
    for at in range(0, depth, _PER_KEY):
        key = np.zeros(len(starts), np.int64)
        for step in range(_PER_KEY):
            key = (key << BITS) | (padded[starts + at + step] if at + step < depth else 0)
        columns.append(key)
    return np.stack(columns, axis=1).astype(">i8").view(f"S{8 * len(columns)}").ravel()


class Block:
    """Part of the benchmark, numbered: its distinct suffixes of up to ``window`` words and their places."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, words in items]
        vocabulary = sorted({w for _, words in items for w in words})
        self.numbers = {w: i + 1 for i, w in enumerate(vocabulary)}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, (_, words) in enumerate(items):
            coded = [self.numbers[w] for w in words]
            size = min(window, len(coded))
            for at in range(len(coded) - size + 1 if coded else 0):
                places.setdefault(tuple(coded[at : at + size]), []).append((item, at))
        patterns = sorted(places)
        self.places = [places[p] for p in patterns]
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        count = len(patterns)
        top = (1 << BITS) - 1
        low = np.zeros((count, window), np.int64)
        high = np.full((count, window), top, np.int64)
        for row, pattern in enumerate(patterns):
            low[row, : len(pattern)] = high[row, : len(pattern)] = pattern
        starts = np.arange(count) * window
        self.low = _keys(low.ravel(), starts, window)
        self.high = _keys(high.ravel(), starts, window)
        # the first words of the patterns, by how many there are to compare
        heads = (low[:, 0] << 2 * BITS) | ((low[:, 1] << BITS) if window > 1 else 0) | (low[:, 2] if window > 2 else 0)
        self.heads = {
            n: np.unique(heads[np.minimum(self.sizes, _PER_KEY) == n] >> BITS * (_PER_KEY - n)) for n in (1, 2, 3)
        }

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence in a shard."""
        nothing = np.zeros(0, np.int64)
        if not len(self.sizes) or not len(numbers):
            return nothing, nothing
        starts = np.flatnonzero(numbers)
        padded = np.concatenate([numbers, np.zeros(2, np.int64)])
        head = (padded[starts] << 2 * BITS) | (padded[starts + 1] << BITS) | padded[starts + 2]
        possible = np.zeros(len(starts), bool)
        for n, wanted in self.heads.items():
            if len(wanted):
                part = head >> BITS * (_PER_KEY - n)
                at = np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)
                possible |= wanted[at] == part
        starts = starts[possible]
        if not len(starts):
            return nothing, nothing
        keys = _keys(numbers, starts, self.window)
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], starts[order]  # the suffix array
        first = np.searchsorted(keys, self.low, "left")
        counts = np.searchsorted(keys, self.high, "right") - first
        patterns = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(patterns)) - np.repeat(np.cumsum(counts) - counts, counts)
        return patterns, suffixes[first[patterns] + within]


def _longest(block: Block, patterns: np.ndarray, starts: np.ndarray) -> list[tuple[str | None, int, int, int]]:
    """Longest verbatim matches of one document: neighbouring windows of one item are one match."""
    found = []
    for pattern, start in zip(patterns.tolist(), starts.tolist()):
        found += [(item, start - at, start, at, int(block.sizes[pattern])) for item, at in block.places[pattern]]
    out: list[list] = []
    last = None
    for item, shift, start, at, size in sorted(found):
        if last == (item, shift, start - 1):
            out[-1][3] += 1
        else:
            out.append([item, at, start, size])
        last = (item, shift, start)
    return [(block.names[i], at, start, size) for i, at, start, size in out]


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, sorted."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    fresh = np.r_[True, spans[1:, 0] > ends[:-1]]
    return np.stack([spans[fresh, 0], ends[np.r_[np.flatnonzero(fresh)[1:] - 1, len(spans) - 1]]], axis=1)


def _mark(batch: pa.RecordBatch, text: str, block: Block, shard_words: int, first: bool) -> pa.RecordBatch:
    split = [split_words(t) for t in texts(batch, text)]
    sizes = np.array([len(w) for w in split], np.int64)
    rows = len(split)
    spans = [np.zeros((0, 2), np.int32)] * rows
    items: list[set[str]] = [set() for _ in range(rows)]
    matches: list[list] = [[] for _ in range(rows)]
    if not first:
        spans = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in batch.column("hit_spans").to_pylist()]
        items = [set(v) for v in batch.column("items").to_pylist()]
        matches = [[(m["item_id"], m["item_start"], m["doc_start"], m["n_words"]) for m in v] for v in batch.column("matches").to_pylist()]
    at = 0
    while at < rows:
        stop, held = at, 0
        while stop < rows and (stop == at or held + sizes[stop] <= shard_words):
            held += sizes[stop]
            stop += 1
        offsets = np.concatenate([[0], np.cumsum(sizes[at:stop] + 1)])  # a zero after each document keeps them apart
        numbers = np.zeros(offsets[-1], np.int64)
        for doc in range(at, stop):
            begin = offsets[doc - at]
            numbers[begin : begin + sizes[doc]] = [block.numbers.get(w, 0) for w in split[doc]]
        patterns, places = block.search(numbers)
        owner = np.searchsorted(offsets, places, "right") - 1
        order = np.lexsort((places, owner))
        patterns, places, owner = patterns[order], places[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(stop - at + 1))
        for doc in np.unique(owner).tolist():
            part = slice(cuts[doc], cuts[doc + 1])
            starts = places[part] - offsets[doc]
            new = np.stack([starts, starts + block.sizes[patterns[part]]], axis=1)
            row = at + doc
            spans[row] = _merge(np.concatenate([spans[row], new])).astype(np.int32)
            found = _longest(block, patterns[part], starts)
            matches[row] += found
            items[row] |= {name for name, *_ in found if name is not None}
        at = stop
    return put_columns(
        batch,
        {
            "n_words": pa.array(sizes, pa.int64()),
            "n_hit": pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
            "hit_spans": pa.array([s.tobytes() for s in spans], pa.binary()),
            "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            "matches": pa.array([[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)) for m in v] for v in matches], _MATCHES),
        },
    )


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words, or one longer item."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        words = split_words(row[1].encode("utf-8") if row[1] else None)
        if len(words) >= 1 << BITS:
            raise ValueError("a single benchmark item has more words than a block can number")
        if held and size + len(words) > block_words:
            yield Block(held, window)
            held, size = [], 0
        if words:
            held.append((row[0], words))
            size += len(words)
    yield Block(held, window)


def find_matches(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All rows and columns of ``df`` with ``n_words``, ``n_hit``, ``items``, ``matches`` and ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window of ``window`` words of an item (an item
    with fewer words is one window). ``items`` has the sorted ids found, ``matches`` the longest verbatim
    matches with their places. ``contaminated``: the hit words are at least one in twenty. NULL and empty
    texts have no words and are clean; items without words match nothing; an item without id marks
    words but is not listed; repeated rows and ids are kept, an id found is listed once. New columns
    replace input columns of the same name. Empty tables are fine on either side.
    """
    context = df.sparkSession.sparkContext
    first = True
    marked = df
    for block in _blocks(benchmark, item, item_text, window, block_words):
        shared = context.broadcast(block)  # bounded by block_words

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    yield _mark(whole.slice(at, 1024), text, shared.value, shard_words, first)

        marked = marked.mapInArrow(run, with_schema(marked, **_STATE))
        first = False
    flagged = marked.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    rest = [c for c in df.columns if c not in (*_STATE, "contaminated")]
    return flagged.select(*[F.col(f"`{c}`") for c in rest], "n_words", "n_hit", "items", "matches", "contaminated")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with the columns of ``df``."""
    return shielded(df, lambda rows, names: find_matches(rows, benchmark, text=names[text], **options).filter(~F.col("contaminated")))
