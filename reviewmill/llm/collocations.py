"""Phrase collocation mining by stripes.

A stripe is a prefix of one to three words with a counter of the words that follow it. Tasks keep stripes of what they
read, and stripes of one prefix are merged elementwise. One merged stripe gives the frequent phrases one word longer, a
lower bound of how often the prefix occurs (the sum, with a rest entry for what is not counted by word; it bounds the
score from above) and its most frequent extension, which tells whether a longer phrase subsumes it.

Words, then pairs, that occur too rarely are left out beforehand by a filter of fixed size that lets everything
frequent pass; what it lets pass wrongly is counted exactly and dropped afterwards. Stripes travel in bundles, at least
as many as the shuffle partitions; stripes of very frequent words are split over several by the following word, in
proportion to their share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.operators.lookup import lookup_join
from reviewmill.session import write_stage

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
SUBSUMED = (80, 100)  # a longer phrase with at least this share of the occurrences replaces a phrase
SCALE = 2_000_000
FILTER_BITS = 25  # 4 MB
HOT_SHARES = 500  # words with more than one in so many occurrences have split stripes; there are fewer than that
WORDS_HELD = 1 << 17  # distinct words a task keeps before it hands on what it counted
ENTRIES_HELD = 1 << 21
ENTRIES_AT_ONCE = 1 << 16
BUNDLES = 4_096  # per language, or more where there are very many shuffle partitions
BUNDLES_A_TASK = 16
BYTES_AT_ONCE = 1 << 22
TOKENS_HELD = 1 << 31
BREAKS = b".,;:!?\n\x0b\x0c\r"  # end a piece
_TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(BREAKS) + b" ")
_BETWEEN = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


class Words(dict):
    """Numbers of the words of one language in one task, in the order they are met. 0 is the break between pieces."""

    def __init__(self, lang: str, before: list[bytes]):
        super().__init__()
        self.lang, self.words, self.seed = lang, [], xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.zeros(0, np.uint64)
        self[b"."]
        self.tail = np.array([self[w] for w in before], np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        found = text.translate(_TABLE).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def stretch(self, text: bytes) -> np.ndarray:
        """The last words of what came before, then those of ``text``: no phrase is lost where a long text is cut."""
        ids = np.concatenate([self.tail, self.numbers(text)])
        self.tail = ids[len(ids) - len(self.tail) :]
        return ids

    def last(self) -> list[bytes]:
        return [self.words[i] for i in self.tail]

    def hashed(self) -> np.ndarray:
        new = self.words[len(self.hashes) :]
        if new:
            more = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, more])
        return self.hashes


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and that word's."""
    mixed = first * np.uint64(_ODD[0]) ^ second
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_ODD[1])


def _pair_hash_int(first: int, second: int) -> int:
    mixed = first * _ODD[0] & _ALL ^ second
    return (mixed ^ mixed >> 29) * _ODD[1] & _ALL


_ODD, _ALL = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (1 << 64) - 1


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts by language, a few megabytes at a time, each text ending in a break; longer ones are cut between words."""
    held, size = {}, 0
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for at, lang in enumerate(langs):
            text = texts[at].as_py()
            if not text:
                continue
            if len(text) > BYTES_AT_ONCE:
                if lang in held:
                    yield lang, b".".join([*held.pop(lang), b""])
                start = 0
                while len(text) - start > BYTES_AT_ONCE and (cut := _BETWEEN.search(text, start + BYTES_AT_ONCE)):
                    yield lang, text[start : cut.end()]
                    start = cut.end()
                text = text[start:]
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > BYTES_AT_ONCE:
                yield from ((k, b".".join([*v, b""])) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b".".join([*v, b""])) for k, v in held.items())


WORD_COUNTS = "lang string, phrase string, n bigint, slot bigint"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, each with its place in the filter."""
    held: dict[str, tuple[Words, list]] = {}

    def flush():
        for words, [counts] in held.values():
            if len(counts) > 1:
                every = np.flatnonzero(counts[1:]) + 1
                for at in range(0, len(every), ENTRIES_AT_ONCE):
                    seen = every[at : at + ENTRIES_AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([words.lang] * len(seen), pa.string()), pa.array([words.words[i] for i in seen], pa.binary()).cast(pa.string()),
                            pa.array(counts[seen]), pa.array(_slot(words.hashed()[seen])),
                        ],
                        names=["lang", "phrase", "n", "slot"],
                    )
        held.clear()

    for lang, text in _stretches(batches):
        words, counts = held.setdefault(lang, (Words(lang, []), [np.zeros(0, np.int64)]))
        more = np.bincount(words.numbers(text), minlength=len(words.words))
        more[: len(counts[0])] += counts[0]
        counts[0] = more
        if sum(len(w.words) for w, _ in held.values()) > WORDS_HELD:
            yield from flush()
    yield from flush()


class Tally:
    """Counts of 64-bit keys, merged when they pile up."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if not len(keys):
            return
        keys, counts = _summed(keys, counts)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > ENTRIES_HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, counts = _summed(keys, counts)
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


STRIPES = "lang string, bundle int, prefixes string, sizes binary, following string, counts binary"


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers of each row side by side, as binary."""
    data = values.astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])


def _stripe_rows(words: Words, prefix: list[np.ndarray], following: np.ndarray, counts: np.ndarray, hot: dict, bundles: int) -> Iterator[pa.RecordBatch]:
    """Stripes of one language in bundles, so that short stripes are not rows of their own.

    A bundle holds its prefixes (one a line), the entries of each, and all words that follow (nothing stands for the rest) with
    their counts. Which bundle an entry goes to follows from the prefix and, for split stripes, from the word.
    """
    names = [w.decode() for w in words.words]
    names[0] = ""
    hashes = words.hashed()
    by_word = np.array([hot.get((words.lang, w), 1) for w in names], np.int64) if hot else np.ones(len(names), np.int64)
    shards = np.minimum.reduce([by_word[p] for p in prefix]).astype(np.uint64)
    shard = np.where(following == 0, np.uint64(0), (hashes[following] >> np.uint64(8)) % shards)
    print_ = hashes[prefix[0]]
    for p in prefix[1:]:
        print_ = pair_hash(print_, hashes[p])
    bundle = ((pair_hash(print_, shard) >> np.uint64(16)) % np.uint64(bundles)).astype(np.int64)
    order = np.lexsort([following, *reversed(prefix), bundle])
    prefix, following, counts, bundle = [p[order] for p in prefix], following[order], counts[order], bundle[order]
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    changed[1:] = bundle[1:] != bundle[:-1]
    rows = np.append(np.flatnonzero(changed), len(order))
    for column in prefix:
        changed[1:] |= column[1:] != column[:-1]
    stripes = np.append(np.flatnonzero(changed), len(order))
    table = pa.array(names, pa.string())
    at = 0
    while at < len(rows) - 1:
        end = max(at + 1, int(np.searchsorted(rows, rows[at] + ENTRIES_AT_ONCE, "right")) - 1)
        low, high, bounds = rows[at], rows[end], rows[at : end + 1]
        inside = stripes[np.searchsorted(stripes, low) : np.searchsorted(stripes, high) + 1]
        stripe_bounds = np.searchsorted(inside, bounds)
        heads = [table.take(pa.array(p[inside[:-1]])) for p in prefix]
        heads = pc.binary_join_element_wise(*heads, " ") if len(heads) > 1 else heads[0]
        follow = pa.ListArray.from_arrays(pa.array(bounds - low, pa.int32()), table.take(pa.array(following[low:high])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words.lang] * (end - at), pa.string()), pa.array(bundle[bounds[:-1]], pa.int32()),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(stripe_bounds, pa.int32()), heads), "\n"),
                _packed(np.diff(inside), stripe_bounds), pc.binary_join(follow, " "), _packed(counts[low:high], bounds - low),
            ],
            names=["lang", "bundle", "prefixes", "sizes", "following", "counts"],
        )
        at = end


class Phrases:
    """Numbers of the phrases met in one task, each known by the one without its last word and that word."""

    def __init__(self):
        self.seen, self.keys = {}, []

    def numbers(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(first << 32 | last, return_inverse=True)
        seen, keys = self.seen, self.keys
        for key in distinct.tolist():
            if key not in seen:
                seen[key] = len(keys)
                keys.append(key)
        return np.array([seen[k] for k in distinct.tolist()], np.int64)[where]

    def parts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(self.keys, np.int64)[numbers]
        return keys >> 32, keys & 0xFFFFFFFF


def count_stripes(size: int, bits, hot, bundles: int) -> Callable:
    """Stripes of phrases of ``size`` words that pass the filter.

    A following word is counted by name if the phrase that starts one word later passes as well, else as the rest. Rests are
    only handed on beside a named word, so the sum of a stripe is a lower bound of the prefix's occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Words, list[Phrases], Tally]] = {}
        tokens = 0

        def flush():
            for words, phrases, tally in held.values():
                keys, counts = tally.merge()
                head, following = keys >> 32, keys & 0xFFFFFFFF
                if len(head):
                    named = np.zeros(head.max() + 1, bool)
                    named[head[following > 0]] = True
                    kept = named[head]
                    head, following, counts = head[kept], following[kept], counts[kept]
                if len(head):
                    prefix = []
                    for level in reversed(phrases):
                        head, last = level.parts(head)
                        prefix.insert(0, last)
                    yield from _stripe_rows(words, [head, *prefix], following, counts, hot.value, bundles)

        for lang, text in _stretches(batches):
            if lang not in held:
                held[lang] = Words(lang, [b"."] * size), [Phrases() for _ in range(size - 1)], Tally()
            words, phrases, tally = held[lang]
            ids = words.stretch(text)
            hashes = words.hashed()
            tokens += len(ids)
            whole = ids > 0
            for k in range(1, size):
                whole = whole[:-1] & (ids[k:] > 0)
            at = np.flatnonzero(whole)
            print_ = hashes[ids[at]]
            for k in range(1, size):
                print_ = pair_hash(print_, hashes[ids[at + k]])
            known = np.zeros(len(ids) + 1, bool)
            at = at[passes(bits.value, print_)]
            known[at] = True
            at = at[at < len(ids) - size]  # the others are met again in the next stretch
            head = ids[at]
            for k, level in enumerate(phrases, 1):
                head = level.numbers(head, ids[at + k])
            tally.add(head << 32 | np.where(known[at + 1], ids[at + size], 0))
            entries = sum(len(w.words) + t.size + sum(len(p.keys) for p in ps) for w, ps, t in held.values())
            if entries > ENTRIES_HELD + WORDS_HELD or tokens > TOKENS_HELD:
                yield from flush()
                held = {k: (Words(k, w.last()), [Phrases() for _ in range(size - 1)], Tally()) for k, (w, _, _) in held.items()}
                tokens = 0
        yield from flush()

    return run


MERGED = "lang string, prefix string, word string, n bigint, most bigint, slot bigint"


def _entries(batch: pa.RecordBatch) -> pa.Table:
    """Entries of sorted bundles, with the number ``at`` of the bundle in the batch and the ``row`` they were read from."""
    changed = np.zeros(batch.num_rows, bool)
    for name in ("lang", "bundle"):
        column = batch.column(name)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    numbers = {n: np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u4").astype(np.int64) for n in ("sizes", "counts")}
    lists = pc.split_pattern(batch.column("following"), " ")
    rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    prefixes = pc.list_flatten(pc.split_pattern(batch.column("prefixes"), "\n"))
    prefix = prefixes.take(pa.array(np.repeat(np.arange(len(prefixes)), numbers["sizes"])))
    return pa.table({"at": np.cumsum(changed)[rows], "prefix": prefix, "word": pc.list_flatten(lists), "n": numbers["counts"], "row": rows})


def merge_stripes(least: int) -> Callable:
    """Merge sorted bundles of stripes elementwise.

    Per stripe: its frequent entries, each with the sum, and (``word`` NULL) its sum and largest entry if there are any. The
    bundle at the end of a batch goes on in the next one, already merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, _Hashes] = {}

        def slot(lang: str, phrase: str) -> int:
            if lang not in seeds:
                seeds[lang] = _Hashes(xxhash.xxh64_intdigest(lang.encode()))
            first, *others = (seeds[lang][w] for w in phrase.split(" "))
            for other in others:
                first = _pair_hash_int(first, other)
            return first >> (64 - FILTER_BITS)

        def grouped(table: pa.Table, keys: list[str], *sums) -> pa.Table:
            return table.group_by(keys, use_threads=False).aggregate(list(sums))

        def merged(table: pa.Table) -> pa.Table:
            out = grouped(table, ["at", "prefix", "word"], ("n", "sum"), ("row", "min"))
            return out.rename_columns(["at", "prefix", "word", "n", "row"])

        def finish(table: pa.Table, langs: pa.Array) -> pa.RecordBatch:
            """Rows of complete bundles; ``row`` points into ``langs``."""
            named = table.filter(pc.and_(pc.greater_equal(table["n"], least), pc.not_equal(table["word"], "")))
            most = grouped(named, ["at", "prefix"], ("n", "max"))
            sums = grouped(table, ["at", "prefix"], ("n", "sum"), ("row", "min")).join(most, ["at", "prefix"], join_type="inner", use_threads=False)
            named = named.join(sums.select(["at", "prefix", "n_sum"]), ["at", "prefix"], join_type="inner", use_threads=False)
            words, n, k = named["word"].to_pylist(), named.num_rows, sums.num_rows
            prefixes = named["prefix"].to_pylist() + sums["prefix"].to_pylist()
            rows = named["row"].to_pylist() + sums["row_min"].to_pylist()
            of = langs.take(pa.array(rows, pa.int64())).to_pylist()
            slots = [slot(lang, f"{p} {w}") for lang, p, w in zip(of, prefixes, words)]
            columns = (
                (of, pa.string()), (prefixes, pa.string()), (words + [None] * k, pa.string()), (named["n"].to_pylist() + sums["n_sum"].to_pylist(), pa.int64()),
                (named["n_sum"].to_pylist() + sums["n_max"].to_pylist(), pa.int64()), (slots + [None] * k, pa.int64()),
            )
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["lang", "prefix", "word", "n", "most", "slot"])

        def kept(table: pa.Table) -> pa.Table:
            """Entries to go on with, as of a bundle numbered 0 and read from row 0."""
            zero = pa.array(np.zeros(table.num_rows, np.int64))
            return pa.table({"at": zero, "prefix": table["prefix"], "word": table["word"], "n": table["n"], "row": zero})

        held, key, lang = None, None, None  # entries of the bundle that may go on, its key, its language as an array
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, bundles = batch.column("lang"), batch.column("bundle")
            table = _entries(batch)
            if held is not None:
                if (langs[0].as_py(), bundles[0].as_py()) == key:
                    table = pa.concat_tables([held, table])
                else:
                    yield finish(held, lang)
            table = merged(table)
            last = pc.max(table["at"])
            done = table.filter(pc.less(table["at"], last))
            if done.num_rows:
                yield finish(done, langs)
            held, lang, key = kept(table.filter(pc.equal(table["at"], last))), langs.slice(len(langs) - 1), (langs[-1].as_py(), bundles[-1].as_py())
        if held is not None:
            yield finish(held, lang)

    return run


class _Hashes(dict):
    """Hashes of words under one seed, computed once per word."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode(), self.seed)
        return found


def frequency_filter(slots: DataFrame) -> np.ndarray:
    """Bits of all ``slot``s set, put together in blocks of 64; at most ``2**FILTER_BITS / 64`` rows reach the driver."""
    block = F.shiftright("slot", 6).alias("block")
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    rows = slots.groupBy(block).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    dealt = stripes.repartition("lang", "bundle").sortWithinPartitions("lang", "bundle")
    return write_stage(dealt.mapInArrow(merge_stripes(least), MERGED), "stripes")


def mine_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    NULL language is ``und``, NULL text is empty. Texts end a piece, as do punctuation and line ends. ``a`` counts the
    phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the language. Ties go by ``a``, then by the
    phrase's bytes. A language without phrases has no rows; neither has an empty table.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    words = rows.mapInArrow(count_words, WORD_COUNTS).groupBy("lang", "phrase", "slot").agg(F.sum("n").alias("n"))
    words = write_stage(words, "words")
    sizes = words.groupBy("lang").agg(F.sum("n").cast("bigint").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    send = spark.sparkContext.broadcast
    total = words.agg(F.sum("n")).head()[0] or 0
    heavy = frequent.filter(F.col("n") * HOT_SHARES > total).collect()  # fewer than HOT_SHARES rows
    hot = send({(r["lang"], r["phrase"]): -(-r["n"] * HOT_SHARES // total) for r in heavy})

    bundles = max(BUNDLES, BUNDLES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits, levels = send(frequency_filter(frequent)), []
    for size in range(1, MAX_WORDS):
        levels.append(_merged(rows.mapInArrow(count_stripes(size, bits, hot, bundles), STRIPES), least))
        if size + 1 < MAX_WORDS:
            bits = send(frequency_filter(levels[-1].filter("word IS NOT NULL")))
    stripes = reduce(DataFrame.unionByName, levels)

    entries = stripes.filter("word IS NOT NULL").select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), "n", F.col("most").alias("before"))
    single = F.instr("phrase", " ") == 0
    prefixes = stripes.filter("word IS NULL").select("lang", F.col("prefix").alias("phrase"), "n", "most")
    counted = entries.select("lang", "phrase", "n").unionByName(frequent.select("lang", "phrase", "n"))

    none = F.lit(None).cast("bigint")
    behind = prefixes.filter(~single & (F.col("most") >= least)).select("lang", "phrase", none.alias("n"), none.alias("before"), "most")
    ahead = entries.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), none.alias("n"), none.alias("before"), F.col("n").alias("most"))
    seen = entries.withColumn("most", none).unionByName(behind).unionByName(ahead.filter(~single)).groupBy("lang", "phrase")
    seen = seen.agg(*[F.max(c).alias(c) for c in ("n", "before", "most")])
    share, of = SUBSUMED
    kept = seen.filter(
        F.col("n").isNotNull() & (F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * of < F.col("n").cast("decimal(20,0)") * share))
    ).select("lang", "phrase", F.col("n").alias("a"), _score("n", "before", "n").alias("bound"))
    return lookup_join(_best(write_stage(kept, "phrases"), counted, top), sizes, {"lang": "lang"}).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _score(a: str, l: str, r: str) -> Column:
    """Whole-number score, exact beyond 64 bits."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST({a} AS DECIMAL(20,0))) div (CAST({l} AS DECIMAL(20,0)) + CAST({r} AS DECIMAL(20,0)))")


def _ranked(df: DataFrame, top: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("a").desc(), "phrase"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))


def _cut_scores(phrases: DataFrame, counted: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase; counts of its parts are looked up."""
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", F.split("phrase", " ").alias("w")).select("*", cut)
    first = F.struct(F.lit(True).alias("left"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part"))
    second = F.struct(F.lit(False).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("part"))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(first, second)).alias("side")).select("lang", "phrase", "a", "k", "side.*")
    found = parts.join(counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    sides = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    best = sides.withColumn("score", _score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _best(phrases: DataFrame, counted: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, without scoring all.

    ``bound`` is an upper bound of the score: that of the last cut, with its right part as rare as the phrase. The phrases
    of the highest bounds are scored first; what cannot reach the last place among them is never looked up.
    """
    first = _ranked(_cut_scores(_ranked(phrases, 2 * top, F.col("bound").desc()), counted), top, F.col("score").desc())
    least = first.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("rank") == top, F.col("score"))), F.lit(0)).alias("least"))
    least = write_stage(least.withColumnRenamed("lang", "of"), "least-scores")
    able = phrases.join(least, (F.col("lang") == F.col("of")) & (F.col("bound") >= F.col("least"))).select(*phrases.columns)
    return _ranked(_cut_scores(able, counted), top, F.col("score").desc())
