"""Arrow batches in and out of Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_schema(df: DataFrame, **columns: str) -> T.StructType:
    """Schema of ``df`` with columns added; a new column replaces one of the same name."""
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
    kept = [f for f in df.schema.fields if f.name not in columns]
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in kept + added.fields])


def put_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added at the end, in the order ``with_schema`` declares."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names] + list(columns.values()), names=names + list(columns)
    )


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def add_columns(
    df: DataFrame, text: str, build: Callable[[list[bytes | None]], dict[str, pa.Array]], rows: int = 512, **columns: str
) -> DataFrame:
    """Apply ``build`` to the texts of every batch; batches are cut to ``rows`` to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield put_columns(batch, build(texts(batch, text)))

    return df.mapInArrow(run, with_schema(df, **columns))


def doc_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs; whatever else a table has can't clash."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shielded(df: DataFrame, operate: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """Run a filtering operator on ``df`` under neutral column names, so that no added column can clash.

    ``operate`` gets the renamed table and the new name of each column; the columns of ``df`` come back.
    """
    names = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    out = operate(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``keys``, all if there are fewer.

    Rows far from the cut are filtered where they are, so that no task gathers ``rows`` from each other one.
    """
    total = max(1, df.count())
    reach = 1 << 30
    cut = int(reach * min(1.0, (rows + 8 * rows**0.5 + 16) / total))
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(reach)))
    return hashed.filter(F.col("_hash") <= cut).orderBy("_hash", *keys).limit(rows).drop("_hash")


def ints(values, kind=pa.int64()) -> pa.Array:
    return pa.array(np.asarray(values), type=kind)
