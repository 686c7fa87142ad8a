"""Quality classifier by compression: which of two zstandard dictionaries, of good or of bad text, fits better."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_rows, tidy

#: A text is compressed in blocks of so many bytes, so that a long text can't become its own dictionary.
BLOCK_BYTES = 1024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Pairs of dictionaries, from texts of their own: which substrings a dictionary keeps is partly chance, and the mean
#: of several pairs varies less.
PAIRS = 4
#: Labelled rows of each class that the fit takes at most, of texts up to SAMPLE_CHARS; of these, those whose
#: texts make a dictionary. The others calibrate.
SAMPLE_ROWS, DICTIONARY_ROWS, SAMPLE_CHARS = 2500, 400, 1 << 16


def chosen(labels: DataFrame, label: str, value: int, rows: int) -> DataFrame:
    """(sampled, part): at most `rows` ids that may be learnt from and have the label; the same ones in each run."""
    few = label_rows(labels, label).where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return few.select(F.col("doc_id").alias("sampled"), F.lit(value).alias("part"))


def sample_texts(docs: DataFrame, few: DataFrame, parts: int, chars: int = SAMPLE_CHARS) -> list[list[str]]:
    """Texts of at most `chars` characters of the ids of `few`, by part; of several texts of one id the least one. Only this
    bounded sample reaches the driver, by one scan of the documents."""
    found = docs.where(F.char_length("text") <= chars).join(F.broadcast(few), F.col("doc_id") == F.col("sampled"))
    got = found.groupBy("part", "sampled").agg(F.min("text").alias("text")).collect()
    out: list[list[str]] = [[] for _ in range(parts)]
    for r in sorted(got, key=lambda r: (r["part"], r["sampled"])):
        out[r["part"]].append(r["text"])
    return out


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def dictionary(texts: list[str]) -> bytes:
    """Trained dictionary; where the texts are too few for training, the texts themselves."""
    samples = [b for t in texts for b in blocks(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * difference + bias))); difference: bytes with the dictionaries of bad text less
    bytes with those of good text, by byte of text, in the mean of the pairs (good, bad)."""

    pairs: tuple[tuple[bytes, bytes], ...]
    slope: float
    bias: float

    def differences(self, texts: Iterable[bytes]) -> np.ndarray:
        made = [tuple(compressor(d) for d in pair) for pair in self.pairs]
        found = []
        for text in texts:
            own = blocks(text)
            found.append(sum(len(bad.compress(b)) - len(good.compress(b)) for b in own for good, bad in made) / max(1, len(text)) / max(1, len(made)))
        return np.array(found, float)

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.bias, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, with a little ridge against separable samples."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `rows` labelled rows of each class, of texts of up to SAMPLE_CHARS characters. The classes are weighted back to their shares among
    all labels, so scores are chances. Without texts of both classes, each score is the share of good labels."""
    share = label_rows(labels, label).agg(F.avg("label")).first()[0]
    texts = sample_texts(docs, chosen(labels, label, 0, rows).unionByName(chosen(labels, label, 1, rows)), 2)
    if not all(texts):
        p = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Model((), 0.0, float(np.log(p / (1 - p))))
    parts = max(1, min(PAIRS, *(len(t) // 40 for t in texts)))
    each = [min(DICTIONARY_ROWS, -(-len(t) // (2 * parts))) for t in texts]
    bad, good = ([dictionary(t[i * n : (i + 1) * n]) for i in range(parts)] for t, n in zip(texts, each, strict=True))
    raw = Model(tuple(zip(good, bad, strict=True)), 1.0, 0.0)
    x0, x1 = (raw.differences(x.encode() for x in t[parts * n :] or t) for t, n in zip(texts, each, strict=True))
    weight = np.repeat([(1 - share) / len(x0), share / len(x1)], [len(x0), len(x1)]) * (len(x0) + len(x1))
    return Model(raw.pairs, *calibrate(np.concatenate([x0, x1]), np.repeat([0.0, 1.0], [len(x0), len(x1)]), weight))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents, and the columns of `keep`.

    Every whole text is compressed, block by block. Null text is scored as empty, and empty as one that neither
    dictionary fits better. Null or repeated doc_id and repeated rows: each row by itself. Empty table: no rows.
    Other columns are ignored."""
    kept = docs.select("doc_id", "text", *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    names = [*kept.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts))], names)

    found = kept.mapInArrow(tidy(run), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], "score double"]))
    extra = [c for c in keep if c != "doc_id"]
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *extra)
