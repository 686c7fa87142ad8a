"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Rolling, held_out, label_rows, text_steps, tidy
from .quality import chosen, sample_texts

#: Confirmed toxic and unlabelled texts that the fit takes at most.
POSITIVE_ROWS, UNLABELLED_ROWS = 2500, 6000
#: A word's features: itself and its first bytes, so that inflected forms meet; hashed into BITS bits.
PREFIXES, BITS = (4, 5, 6), 20
EPOCHS, RATE, RIDGE = 200, 0.05, 1e-4
#: Features in use: those whose shares of toxic and of unlabelled texts differ by Z_SCORE standard errors, the
#: FEATURES with the largest differences at most.
Z_SCORE, FEATURES = 3.0, 4096
#: Prior of the toxic class where labels can't tell, and the least and the largest one.
PRIOR, PRIORS = 0.1, (0.005, 0.5)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): ids[bounds[i]:bounds[i+1]] has a row of features for each distinct word of text i. Words are
    runs of letters: ASCII ones, lower-cased, and all bytes above."""
    inside = np.concatenate([[False], _LETTER[data], [False]])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge], last[edge - 1] = inside[1:-1][edge], inside[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Rolling(_LOWER[data])
    word, owner = hashes.of(start, end), np.searchsorted(offsets, start, side="right") - 1
    order = np.lexsort((word, owner))
    new = np.ones(len(order), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = order[new]
    start, end = start[at], end[at]
    ids = np.stack([word[at], *[hashes.of(start, np.minimum(start + p, end)) + np.uint64(p) for p in PREFIXES]], 1)
    return (ids >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(owner[at], np.arange(len(offsets)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, bounds = features(data, offsets)
        z = _sums(self.weights[ids].sum(1, dtype=np.float64), bounds) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts, step by step."""
    ids, bounds = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_steps(pa.array([t.encode() for t in texts], pa.large_binary())):
        i, b = features(data, offsets)
        ids.append(i)
        bounds.append(b[1:] + bounds[-1][-1])
    return np.concatenate(ids), np.concatenate(bounds)


def _chosen(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Features whose shares of texts differ between the two parts by more than chance."""
    shares, texts = [], [len(bounds) - 1 for _, bounds in parts]
    for ids, bounds in parts:
        seen = np.zeros(1 << BITS)
        for row in range(0, len(bounds) - 1, 500):  # texts at a time
            own = bounds[row : row + 501]
            owner = np.repeat(np.arange(len(own) - 1, dtype=np.int64), np.diff(own))
            each = np.unique((owner[:, None] << BITS) + ids[own[0] : own[-1]])
            seen += np.bincount(each & ((1 << BITS) - 1), minlength=1 << BITS)
        shares.append(seen / (len(bounds) - 1))
    error = sum((s * (1 - s) + 1 / n) / n for s, n in zip(shares, texts, strict=True))
    z = abs(shares[0] - shares[1]) / np.sqrt(error)
    best = np.lexsort((np.arange(len(z)), -z))[:FEATURES]
    return np.sort(best[z[best] >= Z_SCORE])


def train(positive: list[str], unlabelled: list[str], prior: float, epochs: int = EPOCHS) -> Model:
    """Logistic loss under the non-negative risk: prior * R(positive as positive) + max(0, R(unlabelled as negative)
    - prior * R(positive as negative)). Where that difference is negative, the step undoes it instead (Kiryo et al.
    2017). Adam over whole batches, with a ridge."""
    parts = [_joined(positive), _joined(unlabelled)]
    used = _chosen(parts)
    place = np.full(1 << BITS, len(used), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    cells = []  # (text, feature) of each use of a feature, for both parts
    for ids, bounds in parts:
        at = place[ids]
        row, column = np.nonzero(at < len(used))
        cells.append((np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[row], at[row, column], len(bounds) - 1))
    w = np.append(np.zeros(len(used)), np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w)), np.zeros(len(w))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for epoch in range(1, epochs + 1):
        zp, zu = (np.bincount(text, w[feature], texts) + w[-1] for text, feature, texts in cells)
        difference = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_positive = -prior * sigmoid(-zp) / len(zp)
        undone, own = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        slopes = (as_positive + undone, own) if difference >= 0 else (-undone, -own)
        g = np.append(RIDGE * w[:-1], 0.0)
        for (text, feature, _), slope in zip(cells, slopes, strict=True):
            g[:-1] += np.bincount(feature, slope[text], len(used))
            g[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - (epoch - 1) / epochs) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Model:
    """Learns from at most `rows` texts labelled toxic and `unlabelled` texts of any rows that are not held out, each of up
    to SAMPLE_CHARS characters; of the other labels only their share counts, as the prior, which is taken to lie within
    PRIORS. Without a toxic text, each score is the prior."""
    share = label_rows(labels, label).agg(F.avg("label")).first()[0]
    prior = min(max(PRIOR if not share else share, PRIORS[0]), PRIORS[1])
    open_rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    any_rows = open_rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled)
    few = chosen(labels, label, 1, rows).unionByName(any_rows.select(F.col("doc_id").alias("sampled"), F.lit(0).alias("part")))
    others, positive = sample_texts(docs, few, 2)
    if not positive or not others:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    return train(positive, others, prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents.

    Every whole text counts; null text is scored as empty. Null or repeated doc_id and repeated rows: each row by
    itself. Empty table: no rows. Other columns are ignored."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2**BITS numbers
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights.value, bias)
        for batch in batches:
            found = [own.scores(data, offsets) for _, _, data, offsets in text_steps(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
