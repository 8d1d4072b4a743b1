"""Scoring documents with a gated recurrent language model trained on the corpus itself.

Counting, training and scoring all cover every document. Documents are hashed to blocks of bounded size. A
block counts its own words; a word that other blocks hold as well gets its total back by one shuffle keyed
by word, in which a frequent word has one row per block. Training averages the parameters of tasks
that each learn from their part of a slice of the corpus. Scoring reads a block with its totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewmill.llm import gru
from reviewmill.llm.batches import doc_text, texts
from reviewmill.llm.measures import word_hashes
from reviewmill.session import write_stage

VOCABULARY = 2048  # words the network tells apart; all others share one number and their own counts
CLASSES = 32
HIDDEN = 16
WINDOW = 24  # steps of truncated backpropagation
LANES = 512
SLICES = 2  # parameters are averaged after each
RATE = 0.01
BLOCK_CHARS = 16_000_000
TOKENS_AT_ONCE = 1 << 18  # tokens whose hashes are held before they are counted
FOLDS, HELD_OUT = 5, 1
END_HASH = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line break


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, and of its end."""
    return np.append(word_hashes((text or b"").lower().split()), np.uint64(END_HASH))


def _bytes(text: pa.Scalar) -> bytes | None:
    return text.as_buffer().to_pybytes() if text.is_valid else None


def prepare(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, held_out and block. A NULL id counts as the empty text and is learnt from."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", "text", (F.crc32(name.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )


def _count(table: pa.Table) -> pa.Table:
    """Training counts of the distinct tokens of one block."""
    block = table.column("block")[0].as_py()
    parts, held, size = [], [], 0

    def fold() -> None:
        found, place = np.unique(np.concatenate([f for f, _ in held]), return_inverse=True)
        parts.append((found, np.bincount(place, np.repeat([w for _, w in held], [len(f) for f, _ in held]), len(found)).astype(np.int64)))
        held.clear()

    for out, text in zip(table.column("held_out"), table.column("text")):
        held.append((token_hashes(_bytes(text)), not out.as_py()))
        size += len(held[-1][0])
        if size >= TOKENS_AT_ONCE:
            fold()
            size = 0
    if held:
        fold()
    every, place = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(every)).astype(np.int64)
    return pa.table({"block": pa.array(np.full(len(every), block, np.int32)), "hash": pa.array(every.view(np.int64)), "n": pa.array(counts)})


class Vocabulary:
    """The numbered words, and what the unnumbered ones share."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.floor = np.log10(total + 0.5 * (distinct + 1))
        inside = hashes != np.uint64(END_HASH)
        end_count = int(counts[~inside].sum())
        hashes, counts = hashes[inside][: VOCABULARY - 2], counts[inside][: VOCABULARY - 2]
        order = np.argsort(hashes)
        self.hashes = np.concatenate([hashes[order], [np.uint64(END_HASH)]])
        self.numbers = np.concatenate([np.arange(2, len(hashes) + 2)[order], [gru.END]]).astype(np.int32)
        order = np.argsort(self.hashes)
        self.hashes, self.numbers = self.hashes[order], self.numbers[order]
        named = len(hashes) + (end_count > 0)
        self.rest = (total - int(counts.sum()) - end_count) + 0.5 * max(0, distinct - named) + 0.5
        masses = np.zeros(VOCABULARY)
        masses[gru.OTHER], masses[gru.END] = self.rest, end_count + 0.5
        masses[2 : 2 + len(counts)] = counts + 0.5
        self.masses = masses

    def number(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.numbers[at], gru.OTHER).astype(np.int32)


def _train_task(shared, rate: float, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        model = model.unflat(model.flat())
        adam = gru.Adam(model, rate)
        learnt, held, size = 0, [], 0
        for batch in batches:
            for text in texts(batch, "text"):
                held.append(vocabulary.number(token_hashes(text)))
                size += len(held[-1])
                if size >= 800_000:
                    learnt += gru.train(model, held, adam, WINDOW, LANES)
                    held, size = [], 0
        if held:
            learnt += gru.train(model, held, adam, WINDOW, LANES)
        if learnt:
            pieces = np.array_split(model.flat(), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()), pa.array([float(learnt)] * parts), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["part", "weight", "values"],
            )

    return run


def _mean(table: pa.Table) -> pa.Table:
    weights = table.column("weight").to_numpy()
    # a sum in the order of the values, so that the order of arrival does not matter
    rows = sorted(zip(weights.tolist(), table.column("values").to_pylist()))
    total = sum(w for w, _ in rows)
    mean = sum(np.frombuffer(v, np.float32).astype(np.float64) * (w / total) for w, v in rows)
    return pa.table({"part": table.column("part").slice(0, 1), "weight": pa.array([total]), "values": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame, vocabulary: Vocabulary, slices: int = SLICES, parts: int = 32) -> gru.Model:
    """Train on all documents that are not held out, slice by slice."""
    model = gru.new_model(vocabulary.masses, CLASSES, HIDDEN)
    context = docs.sparkSession.sparkContext
    schema = "part int, weight double, values binary"
    for at in range(slices):
        shared = context.broadcast((vocabulary, model))  # of fixed size
        part = docs.filter(~F.col("held_out") & (F.pmod(F.xxhash64("text"), F.lit(slices)) == at)).select("text")
        rate = RATE * (1 - at / (slices + 1))
        learnt = part.mapInArrow(_train_task(shared, rate, parts), schema)
        # two levels, so that no task gathers the parameters of all others
        some = learnt.withColumn("lot", F.pmod(F.xxhash64("values"), F.lit(16)))
        halfway = some.groupBy("part", "lot").applyInArrow(lambda t: _mean(t.select(["part", "weight", "values"])), schema)
        rows = sorted(halfway.groupBy("part").applyInArrow(_mean, schema).collect(), key=lambda r: r["part"])
        if rows:
            model = model.unflat(np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]))
    return model


def _score_block(shared):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        vocabulary, model = shared.value
        found = [token_hashes(t) for t in docs.column("text").cast(pa.large_binary()).to_pylist()]
        lengths = np.array([len(f) for f in found], np.int64)
        held = np.array(docs.column("held_out").to_pylist(), bool)
        every, place = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
        del found
        counts = np.bincount(place, np.repeat(~held, lengths), len(every))
        if totals.num_rows and len(every):
            wider = totals.column("hash").to_numpy().view(np.uint64)
            at = np.searchsorted(every, wider)
            counts[at] = totals.column("total").to_numpy()
        numbers = vocabulary.number(every) if len(every) else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(owner, (np.log10(counts + 0.5) - vocabulary.floor)[place], len(lengths))
        # a word outside the vocabulary: its share of what the unnumbered words have together
        share = np.where(numbers == gru.OTHER, np.log10(counts + 0.5) - np.log10(vocabulary.rest), 0.0)
        extra = np.bincount(owner, share[place], len(lengths))
        known = np.bincount(owner, (counts > 0)[place], len(lengths))
        words = np.split(numbers[place], np.cumsum(lengths)[:-1])
        logs = gru.score(model, words, LANES) / np.log(10) if len(words) else base
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": pa.array(held), "n_tokens": pa.array(lengths),
                "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(lengths), vocabulary.total, np.int64)),
                "base_score": pa.array(base), "score": pa.array(logs + extra),
            }
        )

    return run


def score_documents(df: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row.

    ``base_score`` is the smoothed unigram model's log10-probability of the text, ``score`` the network's; both learn
    from all documents that are not held out. NULL and empty texts are one token, the end. A row without
    doc_id is learnt from. Repeated rows stay and count as often as they occur. With nothing to learn
    from, the scores are those of the smoothing alone. An empty table gives an empty one.
    """
    plain = doc_text(df)
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    docs = prepare(plain, 1 + chars // block_chars)
    own = docs.groupBy("block").applyInArrow(_count, "block int, hash bigint, n bigint")
    by_word = W.partitionBy("hash")
    counted = write_stage(
        own.select(
            "block", "hash", "n", F.sum("n").over(by_word).alias("total"),
            (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"),
        ).filter("first or total > n"),
        "tokens",
    )
    words = counted.filter("first and total > 0")
    sums = words.agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = words.orderBy(F.desc("total"), "hash").limit(VOCABULARY).select("hash", "total").collect()
    vocabulary = Vocabulary(
        np.array([r["hash"] for r in top], np.int64).view(np.uint64), np.array([r["total"] for r in top], np.int64), sums["n"] or 0, sums["v"]
    )
    model = fit(docs, vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, model))
    totals = counted.filter("total > n").select("block", "hash", "total")
    return docs.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score_block(shared),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
