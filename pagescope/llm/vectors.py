"""What the operators on embeddings share: clean vectors in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as float64; without negative zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) + 0.0


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between 1/2 and 1: no square overflows or
    vanishes, no digit changes, and rows that differ by a power of two are equal."""
    return np.ldexp(x, -np.frexp(abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision; of rows as `scaled` gives them, with the same
    digits as the formula on the vectors themselves has."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def with_key(df: DataFrame, *keep: str) -> DataFrame:
    """vector, dim and key (equal for equal vectors only) of the usable rows, and `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            keys = [hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() for v in batch["vector"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    rows = df.where(usable(F.col("embedding"))).select(*keep, F.col("embedding").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector"))
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "key binary"]))
