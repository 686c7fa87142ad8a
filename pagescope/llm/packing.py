"""Best-fit packing by sums of squares: each piece goes where the squared counts of open bins per gap stay smallest."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

SEQUENCE_TOKENS = 2048
#: Id that ends a document.
END_ID = 0
#: Pieces of a SMALL-th of a sequence or more are placed first, by size.
SMALL = 8
#: Pieces of one packing task, about.
TASK_PIECES = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACED = f"{PIECES}, sequence_id long, offset long, gap long"

#: A run without white space as long as this goes to the other library, whose time stays linear.
_LONG_RUN = re.compile(r"\S{4000}")


class Encoder:
    """Ids of texts as the `tokenizers` file gives them without special tokens added.

    The same vocabulary, as ranks, serves a faster library; tests hold both libraries to equal ids. Texts with
    very long runs without white space, and texts that hold the special token's string, are left to `tokenizers`."""

    _made: dict[tuple[str, str | None], Encoder] = {}

    def __init__(self, path: str, ranks: str | None):
        self.path, self._slow = path, None
        with open(path, "rb") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    @classmethod
    def of(cls, path: str, ranks: str | None) -> Encoder:
        if (path, ranks) not in cls._made:
            cls._made[path, ranks] = cls(path, ranks)
        return cls._made[path, ranks]

    @property
    def slow(self):  # noqa: ANN201
        """The contract's library; few texts need it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or _LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, most: int = SEQUENCE_TOKENS, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """PIECES of each row: its ids and END_ID, cut into `most` ids where longer; the first piece takes the rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (tokenizer, ranks) if tokenizer else public_files()
        encoder = Encoder.of(*files)
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), END_ID], "<u4")
                start, length = 0, (len(ids) - 1) % most + 1
                for piece in range(-(-len(ids) // most)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), row))
                    start, length = start + length, most
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(tidy(encode), PIECES)


class SumOfSquares:
    """Bins by residual gap. A piece of size s goes to the gap (or a new bin) for which the sum over all gaps of the
    squared number of open bins grows least; ties go to the smallest gap. Full bins are closed."""

    def __init__(self, most: int):
        self.most, self.open = most, [[] for _ in range(most + 1)]
        self.count = np.zeros(most + 1, np.int64)
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset."""
        most, n = self.most, self.count
        grow = 2 * n[: most + 1 - size] + 1  # of the gap that is left; gap 0 is closed and counts nothing
        grow[0] = 0
        change = grow - 2 * n[size:] + 1
        change[n[size:] == 0] = 1 << 62
        change[-1] = grow[-1]  # a new bin
        gap = int(change.argmin()) + size
        if gap == most:
            at = self.bins
            self.bins += 1
        else:
            at = self.open[gap].pop()
            n[gap] -= 1
        if left := gap - size:
            self.open[left].append(at)
            n[left] += 1
        return at, most - gap


def _pack(rows: DataFrame, tasks: int, most: int, turn: int) -> DataFrame:
    """PLACED: rows packed in `tasks` tasks, each by itself. gap: what its sequence has left at the end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        size = table["length"].to_numpy()
        bins, at = SumOfSquares(most), np.zeros((2, len(size)), np.int64)
        for i, s in enumerate(size.tolist()):
            at[:, i] = bins.place(s)
        used = np.bincount(at[0], weights=size, minlength=bins.bins).astype(np.int64)
        ids = (turn << 56) + (TaskContext.get().partitionId() << 32) + at[0]
        columns = [*[table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")], pa.array(ids), pa.array(at[1]), pa.array(most - used[at[0]])]
        yield from pa.Table.from_arrays(columns, [f.split()[0] for f in PLACED.split(", ")]).to_batches(max_chunksize=20_000)

    # Large pieces by size, then the small ones as they come: in the sums' favourite order, sizes mixed, they fill what
    # is left. The order within a task, and so the result, depends on the rows only.
    large = F.when(F.col("length") * SMALL >= most, F.col("length")).otherwise(0)
    dealt = rows.repartition(tasks, "row", "piece").sortWithinPartitions(large.desc(), F.xxhash64("row", "piece"), "row", "piece")
    return dealt.mapInArrow(tidy(pack), PLACED)


def pack(docs: DataFrame, most: int = SEQUENCE_TOKENS, tokenizer: str | None = None, ranks: str | None = None, task_pieces: int = TASK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of documents.

    The ids are made once and written as slim rows of pieces. Full pieces are sequences by themselves; the others
    are dealt by hash to tasks of about `task_pieces` pieces, where SumOfSquares places them, large ones first. The
    pieces of sequences that have 2 % or more left are packed again, together, over fewer tasks, until one task
    has them or nothing changes. Texts are encoded whole; only pieces travel.

    Null or empty text: the one id that ends a document. Null or repeated doc_id and repeated rows: each row is
    packed by itself. Empty table: no rows. Other columns are ignored."""
    found = cut(pieces(docs, most, tokenizer, ranks))
    full = found.where(F.col("length") == most).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, turn = found.where(F.col("length") < most), [full], 1
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    while True:
        tasks = max(1, -(-rest.count() // task_pieces))
        placed = cut(_pack(rest, tasks, most, turn))
        if tasks == 1 or turn > 100:
            done.append(placed)
            break
        loose = F.col("gap") * 50 >= most
        done.append(placed.where(~loose))
        rest, turn = placed.where(loose).select(*found.columns), turn + 1
    whole = done[0].select(*out)
    for part in done[1:]:
        whole = whole.unionByName(part.select(*out))
    return whole

