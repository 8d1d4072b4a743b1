"""Quality classifier without labels: heuristic labellers, their accuracies, and a scorer trained on them.

Every labeller says good (1), bad (-1) or nothing (0) of a text. How often each pattern of votes occurs is all
that expectation-maximisation needs, and there are at most 3 ** labellers patterns, however large the corpus.
It estimates for each labeller how often it says what of good and of bad texts. The posterior of a
text's pattern is its soft label, and a hashed linear scorer learns from those. Insults are judged the
same way by labellers and a scorer of their own; where labelled rows are given, one of those labellers knows
word starts that toxic texts of a bounded sample hold far more often than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import add_columns, doc_text, hash_sample, texts
from reviewmill.llm.linear import Scorer, families, fit
from reviewmill.llm.measures import Measures, measure
from reviewmill.llm.quality import sample_features
from reviewmill.session import write_stage

TRAIN_ROWS = 1200  # bound of the sample the scorer is fitted on
TOXIC_ROWS = 600  # bound of the insulting texts added to the sample of the second scorer
KEEP_PROBABILITY = 0.5
STEPS = 50

# Fixed word lists.
COMMON_WORDS = frozenset(
    (
        "the of and to in is it that was for on are with as be at this have from or by not he she you we "
        "der die das und ist nicht ein eine zu den von mit auf für im dem des sich auch es an als "
        "le la les et de un une est que qui dans pour pas sur au avec ce il elle en du "
        "el los las y es en un una que por con para no se del al lo como su"
    ).split()
)
INSULTS = frozenset(
    (
        "idiot idiots stupid moron morons loser losers scum trash pathetic disgusting worthless clown clowns dumb imbecile "
        "trottel dummkopf schwachkopf arschloch abschaum versager idioten connard connards crétin crétins abruti abrutis imbécile "
        "imbéciles salaud estúpido estúpida imbécil imbéciles idiotas escoria gilipollas"
    ).split()
)
MARK_SHARE = 0.01  # of the words of a text that must start like a mark
MARK_ROWS = 2000  # bound of the labelled texts of either kind that marks are learnt from
MARK_LENGTHS = (3, 4, 6)  # characters of a mark
MARK_SUPPORT = 5  # labelled toxic texts that hold a mark, at least
MARK_LIFT = 10  # how much more often toxic texts hold it
MAX_MARKS = 500
_TRIM = ".,;:!?\"'()*#$%&|"


_COMMON_BYTES = frozenset(w.encode("utf-8") for w in COMMON_WORDS)


def _say(value: float, bad_from: float, good_to: float) -> int:
    """Bad from one bound on, good up to the other, nothing between."""
    return -1 if value >= bad_from else 1 if value <= good_to else 0


def votes(text: bytes | None, m: Measures) -> list[int]:
    """Votes on quality. An empty text gets no vote but that on length."""
    words = (text or b"").split()
    n = max(1, m.n_words)
    if not words:
        return [-1, 0, 0, 0, 0, 0, 0]
    return [
        -1 if m.n_words < 20 else 1 if m.n_words >= 60 else 0,
        _say(m.n_symbols / n, 0.1, 0.02),
        _say(m.n_repeat_words / n, 0.4, 0.1),
        _say(m.upper / max(1, m.letters), 0.3, 0.1),
        _say(-sum([w.strip(b".,;:!?\"'()") in _COMMON_BYTES for w in text.lower().split()]) / n, -0.03, -0.08),
        _say((text.count(b"!!") + text.count(b" | ")) / n, 0.1, 0.02),
        _say(m.top_word / n if m.n_words >= 20 else 0, 0.25, 0.15),
    ]


def _plain_words(text: bytes | None) -> list[str]:
    words = [w.strip(_TRIM) for w in (text or b"").decode("utf-8", "replace").lower().split()]
    return [w for w in words if w]


def insult_votes(text: bytes | None, marks: frozenset[str] = frozenset()) -> list[int]:
    """Votes on insults: -1 where there are any, several, or many for the length; a single marked word says nothing."""
    words = _plain_words(text)
    hits = [w for w in words if w in INSULTS]
    if marks:
        short, middle, long = MARK_LENGTHS
        marked = [w for w in words if w[:short] in marks or w[:middle] in marks or w[:long] in marks]
        if len(marked) > 1 and len(marked) >= MARK_SHARE * len(words):
            hits += marked
    return [-1 if hits else 1, -1 if len(set(hits)) > 1 else 1 if not hits else 0, _say(len(hits) / max(1, len(words)), 0.01, 0.0)]


def learn_marks(docs: DataFrame, labels: DataFrame, rows: int = MARK_ROWS) -> frozenset[str]:
    """Word starts that labelled toxic texts hold at least ``MARK_LIFT`` times as often as the other labelled ones.

    Learnt from at most ``rows`` texts of either kind. Labels whose crc32 of doc_id mod 5 is 1 are held out for tests.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1)
    chosen = hash_sample(known.filter("toxic = 1"), rows, "doc_id").unionByName(hash_sample(known.filter("toxic = 0"), rows, "doc_id"))
    sample = write_stage(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "mark_sample")  # twice the bound of ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            for text, toxic in zip(texts(batch, "text"), batch.column("toxic").to_pylist()):
                words = _plain_words(text)
                for start in {w[:n] for w in words for n in MARK_LENGTHS if len(w) >= n}:
                    held.setdefault(start, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (1, 0))], names=["start", "bad", "good"]
            )

    sizes = sample.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()
    counted = sample.mapInArrow(count, "start string, bad bigint, good bigint").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    telling = counted.filter((F.col("bad") >= MARK_SUPPORT) & (F.col("bad") * sizes["good"] >= MARK_LIFT * (F.col("good") + 1) * sizes["bad"]))
    return frozenset(r["start"] for r in telling.orderBy(F.desc("bad"), "start").limit(MAX_MARKS).collect())


def number(given: list[int]) -> int:
    """A pattern of votes as one number to the base three."""
    out = 0
    for vote in given:
        out = out * 3 + vote + 1
    return out


def expect(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the labellers' accuracies where they vote.

    ``patterns`` is rows x labellers with -1, 0, 1. Starts from the share of good votes.
    """
    voted = np.abs(patterns).sum(axis=1)
    good = (1 + patterns.sum(axis=1) / np.maximum(voted, 1)) / 2
    good = np.clip(good, 0.05, 0.95)
    says = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(steps):
        of_good = np.einsum("i,ijk->jk", counts * good, says) + [0.1, 0.1, 1.0]
        of_bad = np.einsum("i,ijk->jk", counts * (1 - good), says) + [1.0, 0.1, 0.1]
        of_good /= of_good.sum(axis=1, keepdims=True)
        of_bad /= of_bad.sum(axis=1, keepdims=True)
        share = np.clip((counts * good).sum() / max(1.0, counts.sum()), 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share)) + np.einsum("ijk,jk->i", says, np.log(of_good / of_bad))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = np.einsum("i,ij->j", counts * good, patterns == 1) + np.einsum("i,ij->j", counts * (1 - good), patterns == -1)
    accuracy = right / np.maximum(1e-9, np.einsum("i,ij->j", counts, patterns != 0))
    return good, accuracy


def _spell(code: int, size: int) -> list[int]:
    out = []
    for _ in range(size):
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


class LabelModel:
    """Posteriors by pattern; a pattern that never occurred gets one half."""

    def __init__(self, tally: dict[int, int], size: int):
        codes = sorted(tally)
        patterns = np.array([_spell(c, size) for c in codes], int).reshape(-1, size)
        good, self.accuracy = expect(patterns, np.array([tally[c] for c in codes], float))
        self.posterior = dict(zip(codes, good.tolist()))

    def __call__(self, given: list[int]) -> float:
        return self.posterior.get(number(given), 0.5)


def learn(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, marks: frozenset[str] = frozenset()
) -> tuple[LabelModel, LabelModel, Scorer, Scorer]:
    """Label models from the votes on all documents, and a scorer of each from a bounded sample of them.

    Insults are rare, so the second sample holds the first and up to ``TOXIC_ROWS`` texts judged insulting.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = texts(batch, "text")
                quality = [number(votes(t, measure(t))) for t in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(quality, pa.int32()), pa.array([number(insult_votes(t, marks)) for t in found], pa.int32())],
                    names=["doc_id", "quality", "insult"],
                )

    # every text is judged once; at most 3 ** 7 times 3 ** 3 rows come back
    judged = write_stage(docs.select("doc_id", "text").mapInArrow(tally, "doc_id bigint, quality int, insult int"), "votes")
    rows = judged.groupBy("quality", "insult").count().collect()
    totals: list[dict[int, int]] = [{}, {}]
    for row in rows:
        for held, name in zip(totals, ("quality", "insult")):
            held[row[name]] = held.get(row[name], 0) + row["count"]
    quality, insult = LabelModel(totals[0], 7), LabelModel(totals[1], 3)
    insulting = [code for code, posterior in insult.posterior.items() if posterior < 0.5]

    known = docs.filter(F.col("doc_id").isNotNull())
    ids = hash_sample(known.select("doc_id").distinct(), train_rows, "doc_id")
    rare = hash_sample(judged.filter(F.col("doc_id").isNotNull() & F.col("insult").isin(insulting)).select("doc_id").distinct(), min(train_rows, TOXIC_ROWS), "doc_id")
    both = ids.withColumn("common", F.lit(1)).unionByName(rare.withColumn("common", F.lit(0))).groupBy("doc_id").agg(F.max("common").alias("common"))
    chosen = write_stage(docs.join(F.broadcast(both), "doc_id").dropDuplicates(["doc_id"]), "weak_sample")  # at most both bounds of ids

    def label(model: LabelModel, vote: Callable[[bytes | None], list[int]]):
        return lambda values: {"target": pa.array([model(vote(v)) for v in values], pa.float64())}

    by_quality = add_columns(chosen.filter("common = 1"), "text", label(quality, lambda v: votes(v, measure(v))), target="double")
    by_insult = add_columns(chosen, "text", label(insult, lambda v: insult_votes(v, marks)), target="double")
    return quality, insult, fit(*sample_features(by_quality)), fit(*sample_features(by_insult))


def classify(
    df: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, keep_probability: float = KEEP_PROBABILITY, labels: DataFrame | None = None
) -> DataFrame:
    """All rows and columns of ``df`` with ``label_quality``, ``quality``, ``toxicity`` and ``kept``.

    ``label_quality`` is the posterior of the votes, ``quality`` the scorer's probability. ``toxicity`` is
    the mean of the posterior of insults and the second scorer's probability of them.
    ``labels`` (``doc_id``, ``toxic``), if given, teach word starts that mark toxic texts; without them only the fixed insults speak.
    ``kept``: the quality is high enough and the text more likely free of insults. A NULL or empty text is judged
    by its length alone. Repeated rows count as often as they occur. The new columns replace input columns
    of the same name. An empty table gives an empty one.
    """
    docs = df.select("doc_id", F.col(f"`{text}`").alias("text")).transform(doc_text)
    marks = learn_marks(docs, labels) if labels is not None else frozenset()
    learnt = learn(docs, train_rows, marks)
    shared = df.sparkSession.sparkContext.broadcast(learnt)  # of fixed size

    def build(values: list[bytes | None]) -> dict[str, pa.Array]:
        by_votes, by_insults, by_words, free = shared.value
        found = [measure(v) for v in values]
        label = np.array([by_votes(votes(v, m)) for v, m in zip(values, found)], float)
        good, toxic = np.empty(len(values)), np.empty(len(values))
        for i, (v, m) in enumerate(zip(values, found)):
            grams = families(v or b"", m.hashes)
            good[i] = by_words.probability(v or b"", m.hashes, grams)
            toxic[i] = 1 - (by_insults(insult_votes(v, marks)) + free.probability(v or b"", m.hashes, grams)) / 2
        return {
            "label_quality": pa.array(label, pa.float64()), "quality": pa.array(good, pa.float64()),
            "toxicity": pa.array(toxic, pa.float64()), "kept": pa.array((good >= keep_probability) & (toxic < 0.5), pa.bool_()),
        }

    return add_columns(df, text, build, label_quality="double", quality="double", toxicity="double", kept="boolean")
