"""Quality rules: fixed counts, and a calibrated n-gram classifier trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import add_columns, doc_text, hash_sample, ints, shielded, texts
from reviewmill.llm.linear import Scorer, fit, sparse
from reviewmill.llm.measures import measure

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_PROBABILITY = 0.5
TRAIN_ROWS = 1200  # bound of the labelled sample the classifier is fitted on
CALIBRATION_FOLD = 5


def sample_features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Sparse features, targets and calibration flags of (doc_id, text, target) rows, a bounded sample."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [sparse(t or b"", measure(t).hashes) for t in texts(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("target"),
                     pa.array([n.tobytes() for n, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                    names=["doc_id", "target", "numbers", "values"],
                )

    got = rows.select("doc_id", F.col("target").cast("double").alias("target"), "text").mapInArrow(
        featurise, "doc_id bigint, target double, numbers binary, values binary"
    )
    # the order of arrival must not decide the sums
    local = sorted(got.collect(), key=lambda r: (r["doc_id"], r["target"], r["numbers"], r["values"]))
    features = [(np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["values"], np.float32)) for r in local]
    targets = np.array([r["target"] for r in local], float)
    held_out = np.array([_fold(r["doc_id"]) == 0 for r in local], bool)
    return features, targets, held_out


def _fold(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % CALIBRATION_FOLD


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Fit on up to ``train_rows`` labelled documents, chosen by a hash of their id.

    Labels without document or quality are left out; several labels of a document count as their largest.
    """
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    targets = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("target"))
    chosen = hash_sample(targets, train_rows, "doc_id")
    sample = doc_text(documents).join(F.broadcast(chosen), "doc_id")  # at most train_rows small rows
    return fit(*sample_features(sample.dropDuplicates(["doc_id"])))


def judge(
    df: DataFrame,
    labels: DataFrame,
    documents: DataFrame | None = None,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    keep_probability: float = KEEP_PROBABILITY,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """All rows and columns of ``df`` with the counts, ``base_failed``, ``quality`` and ``kept``.

    The classifier learns from ``documents`` (default ``df``) that ``labels`` names. ``quality`` is the
    probability of a good text; ``kept`` needs it to reach ``keep_probability`` and the base rules to
    hold. NULL and empty texts have no words and fail. Without labels every text has one half and the
    base rules alone decide. Repeated rows stay repeated. The new columns replace input columns of the
    same name. An empty table gives an empty one.
    """
    scorer = train(df if documents is None else documents, labels, train_rows)
    shared = df.sparkSession.sparkContext.broadcast(scorer)  # a weight table of fixed size

    def build(values: list[bytes | None]) -> dict[str, pa.Array]:
        found = [measure(v) for v in values]
        failed = [m.n_words < min_words or 100 * m.n_repeat_words > max_repeat_percent * m.n_words for m in found]
        quality = np.array([shared.value.probability(v or b"", m.hashes) for v, m in zip(values, found)], float)
        return {
            **{n: ints([getattr(m, n) for m in found]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            "base_failed": pa.array(failed, pa.bool_()),
            "quality": pa.array(quality, pa.float64()),
            "kept": pa.array(~np.array(failed, bool) & (quality >= keep_probability), pa.bool_()),
        }

    counts = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint")
    return add_columns(df, text, build, **counts, base_failed="boolean", quality="double", kept="boolean")


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df``; ``doc_id`` and ``text`` name the labelled texts."""
    documents = df.select("doc_id", F.col(f"`{text}`").alias("text"))
    return shielded(df, lambda rows, names: judge(rows, labels, documents, text=names[text], **options).filter("kept"))
