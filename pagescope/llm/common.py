"""What several operators share: tables, cut lineage, whole texts as byte arrays, hashes of bytes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside this class; the same in Java, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Bytes of the Arrow batches between Spark and Python; texts are long, and rows of a batch are in memory together.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have BATCH_BYTES at most, unless it has another setting than the default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, which gives the memory that it has freed back to the system at the end: workers are used again."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one only where none is set and all tasks run on this machine, as in
    tests: on a cluster the executors share no such folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def _cuts(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cuts-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors cost nothing. The table stays
    until `clean`, as results may still be read from it."""
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what `cut` has written in this application; results that are not written yet are lost with it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def label_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) for labels 0 and 1 of rows that may be learnt from: crc32(doc_id as text) mod 5 is not 0.

    A document with several labels counts once, with the largest."""
    learn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return learn.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text (null: empty), mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of neighbouring texts of up to `most` bytes together; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, whole[at[row] : at[end]], (at[row : end + 1] - at[row]).astype(np.int64)
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of substrings of a byte array in constant time each, modulo 2**64 with a random odd base and
    random values of the bytes, finished by mix64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            n = max(n, STEP_BYTES + 1024)
            found = []
            for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                found.append(np.multiply.accumulate(p))
            cls._up, cls._down = found
        return cls._up, cls._down

    def __init__(self, data: np.ndarray):
        self.up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each data[start:end]; equal bytes of equal length have equal hashes."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        """Hash of data[i:i+k] for each i."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts in data; words never cross from one text to the next."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of text i, ASCII lower case, are hashes[bounds[i]:bounds[i+1]],
    ascending. A text of fewer words has its whole sequence as its one shingle, a text without words has none."""
    texts = len(offsets) - 1
    start, end = word_bounds(data, offsets)
    word = Rolling(_LOWER[data]).of(start, end)
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < k))
    n = len(word) - k + 1
    if n > 0:
        inside = text[:n] == text[k - 1 :]
        got = np.zeros(n, np.uint64)
        for j in range(k):
            got = mix64(got * np.uint64(0x9E3779B97F4A7C15) + word[j : n + j])
        got, owner = got[inside], text[:n][inside]
    else:
        got, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            at = first[short][has] + j
            whole[has] = mix64(whole[has] * np.uint64(0x9E3779B97F4A7C15) + word[at] + np.uint64(1))
        got, owner = np.concatenate([got, mix64(whole + np.uint64(7))]), np.concatenate([owner, short])
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    if len(got):
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
        got, owner = got[new], owner[new]
    return got, np.searchsorted(owner, np.arange(texts + 1))
