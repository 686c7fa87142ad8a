"""Removal of byte strings that occur more than once, by suffix arrays over the stretches that can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, STEP_BYTES, cut, mix64, tidy
from .gsaca import suffix_array

#: Bytes of a string that counts as repeated, and of the substrings that anchor one.
WINDOW, GRAM = 200, 24
#: Anchors that occur more often than this are not compared in one task.
HOT = 4096
#: A chunk of a stretch, one symbol of the suffix array, ends where the hash of CUT bytes is the least of its neighbours up
#: to RADIUS places away, on both sides; so texts of short periods have such places, too.
CUT, RADIUS = 4, 16
#: Positions that are looked at together, in one text.
SEGMENT = 1 << 22


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of start[i], start[i] + 1, ... length[i] values each."""
    owner = np.repeat(np.arange(len(start)), length)
    first = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, np.int64)
    return owner, start[owner] + np.arange(len(owner)) - first[owner]


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, low, high, covered starts, covered ends) for texts in data.

    The anchor of a window is its leftmost substring of `gram` bytes with the least hash, so equal windows have equal
    anchors at equal places. Neighbouring windows of a text share anchors: one row for windows low..high of a
    text. A window that is equal to the one before it at the distance of two neighbouring equal anchors is left
    out, as that one stands for it; where that happens both are covered (starts and ends in data)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    length = np.diff(offsets)
    has = np.flatnonzero(length >= window)
    if not len(has):
        return none
    rolling = Rolling(data)
    grams, whole = rolling.all(gram), rolling.all(window)
    change = np.zeros(len(data) + 1, np.int8)
    change[offsets[has]] += 1
    change[offsets[has + 1] - window + 1] -= 1
    valid = np.cumsum(change[: len(whole)]).astype(bool)
    owner = np.empty(len(whole), np.int64)
    span = window - gram + 1
    for at in range(0, len(whole), SEGMENT):
        n = min(SEGMENT, len(whole) - at)
        low = grams[at : at + n + span - 1] >> np.uint64(24) << np.uint64(24) | np.arange(n + span - 1, dtype=np.uint64)
        wide = 1
        while wide * 2 <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        owner[at : at + n] = (np.minimum(low[:n], low[span - wide : span - wide + n]) & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    new = np.append(True, (owner[1:] != owner[:-1]) | ~valid[:-1]) & valid
    low = np.flatnonzero(new)
    high = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    at = owner[low]
    text = np.searchsorted(offsets, low, side="right") - 1
    name = grams[at]
    covered = none[4:]
    again = np.flatnonzero((name[1:] == name[:-1]) & (text[1:] == text[:-1])) + 1
    if len(again):
        distance = at[again] - at[again - 1]
        of, p = _ragged(low[again], high[again] - low[again] + 1)
        before = p - distance[of]
        same = before >= offsets[text[again]][of]
        same[same] = whole[p[same]] == whole[before[same]]
        same[same] = _equal(data, p[same], before[same], window)
        mark = np.zeros(len(whole), bool)
        mark[p[same]] = mark[before[same]] = True
        first, last = _runs(mark)  # of one text each: other texts' windows lie apart
        covered = (first, last - 1 + window)
        left, lows, highs = np.ones(len(low), bool), low.copy(), high.copy()
        left[again] = False
        kept_of, kept_p = of[~same], p[~same]
        if len(kept_of):
            first = np.append(True, kept_of[1:] != kept_of[:-1])
            rows = again[kept_of[first]]
            left[rows] = True
            lows[rows], highs[rows] = kept_p[first], kept_p[np.append(first[1:], True)]
        text, name, low, high = text[left], name[left], lows[left], highs[left]
    return text, name.view(np.int64), low, high, *covered


def _equal(data: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Whether data[one[i]:one[i] + length] and data[two[i]:two[i] + length] are equal, byte by byte. Neighbours that go on
    together are compared in one go; one must be ascending."""
    if not len(one):
        return np.zeros(0, bool)
    new = np.append(True, (np.diff(one) != 1) | (np.diff(two) != 1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(one))) + length - 1
    out = np.ones(len(one), bool)
    for low, high in _steps(size):
        run, at = _ragged(one[first[low:high]], size[low:high])
        differs = data[at] != data[at + (two - one)[first[low:high]][run]]
        if differs.any():
            start = at - one[first[low:high]][run] - length + 1  # first window of its run that has the byte
            for i in np.flatnonzero(differs).tolist():
                of = first[low + run[i]]
                out[of + max(0, int(start[i])) : of + min(int(at[i] - one[of]), int(size[low + run[i]]) - length) + 1] = False
    return out


def _steps(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring items of SEGMENT together, about."""
    total, low = np.cumsum(size), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + SEGMENT, side="right")))
        yield low, high
        low = high


def _sorted_common(symbol: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of symbol, and for each of its entries but the last the symbols that it has in common with the
    next one: `most` at most, and no more than are left in either's stretch."""
    order = np.array(suffix_array(symbol), np.int64)
    one, two = order[:-1], order[1:]
    common, reach = np.zeros(len(one), np.int64), np.minimum(np.minimum(left[one], left[two]), most)
    going, step = np.flatnonzero(reach > 0), 0
    while len(going):
        going = going[symbol[one[going] + step] == symbol[two[going] + step]]
        step += 1
        common[going] = step
        going = going[reach[going] > step]
    return order, common


def _intervals(common: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, whether it holds others): of the interval of the suffix array around each rank whose neighbours have `least`
    symbols in common."""
    table = [common]
    while len(table[-1]) > 1 << (len(table) - 1):
        wide = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-wide], table[-1][wide:]))
    start = rank.copy()
    for level in range(len(table) - 1, -1, -1):
        if not len(table[level]):
            continue
        before = start - (1 << level)
        goes = (before >= 0) & (table[level][np.maximum(before, 0).clip(max=len(table[level]) - 1)] >= least)
        start[goes] = before[goes]
    after = np.append(common, 0)[rank] >= least
    return start, after | (start < rank)


def _least_near(hashes: np.ndarray, radius: int) -> np.ndarray:
    """Places whose hash is not above any other up to `radius` places away; the outermost places are none."""
    if len(hashes) <= 2 * radius:
        return np.zeros(0, np.int64)
    least, wide = hashes, 1
    while wide * 2 <= 2 * radius + 1:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    rest = 2 * radius + 1 - wide
    least = np.minimum(least[: len(least) - rest], least[rest:])
    return np.flatnonzero(hashes[radius : len(hashes) - radius] == least) + radius


def _cuts(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, bounds, symbols, chunks left): places where the content says that a chunk of its stretch ends and the next one
    starts; stretch i has the cuts bounds[i]:bounds[i + 1]. A chunk is a symbol, 0 the end of a stretch."""
    cuts = _least_near(rolling.all(CUT), radius)
    stretch = np.searchsorted(offsets, cuts, side="right") - 1
    inside = (cuts - radius >= offsets[stretch]) & (cuts + CUT + radius <= offsets[stretch + 1])
    cuts, stretch = cuts[inside], stretch[inside]
    bounds = np.searchsorted(stretch, np.arange(len(offsets)))
    symbol = np.zeros(len(cuts), np.int64)
    if len(cuts) > 1:
        follows = np.append(stretch[1:] == stretch[:-1], False)  # the chunk from this cut to the next is whole
        _, rank = np.unique(rolling.of(cuts[:-1], cuts[1:])[follows[:-1]], return_inverse=True)
        symbol[follows] = rank + 1
    return cuts, bounds, symbol, bounds[1:][stretch] - 1 - np.arange(len(cuts))


def _twice(key: np.ndarray, at: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """The windows at `at` (ascending) that another one with the same key equals, byte by byte."""
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    several = times[which] > 1
    which, at = which[several], at[several]
    if not len(at):
        return at
    order = np.argsort(which, kind="stable")
    start = np.searchsorted(which[order], which[order])
    partner = np.empty(len(at), np.int64)
    partner[order] = at[order[np.where(start == np.arange(len(order)), np.minimum(start + 1, len(order) - 1), start)]]
    same = _equal(data, at, partner, window)
    if not same.all():  # equal keys of different windows: each such key by its windows' bytes
        for one in np.unique(which[~same]).tolist():
            own = np.flatnonzero(which == one)
            texts = [data[at[i] : at[i] + window].tobytes() for i in own.tolist()]
            same[own] = [texts.count(t) > 1 for t in texts]
    return at[same]


def _by_chunks(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Places of the windows in data that occur again in their group, by the suffix array of the stretches' chunks.

    A window's whole chunks, k of them from its first cut on, are those of the windows whose first cuts lie in the
    same interval of the suffix array: the one whose neighbours have k symbols in common. Of these, windows with the
    same bytes before the first and after the last cut are the same, which their bytes confirm. Windows without a whole
    chunk go to the suffix array of their bytes."""
    rolling = Rolling(data)
    radius = min(RADIUS, window // 12)
    cuts, bounds, symbol, left = _cuts(data, offsets, rolling, radius)
    of, p = _ragged(offsets[:-1], np.maximum(0, np.diff(offsets) - window + 1))
    low = np.searchsorted(cuts, p + radius)  # others depend on bytes outside
    high = np.minimum(np.searchsorted(cuts, p + window - CUT - radius, side="right"), bounds[1:][of]) - 1
    chunks = high - low
    bare = chunks <= 0
    found = [_by_bytes(data, of[bare], p[bare], group, window)] if bare.any() else []
    of, p, low, high, chunks = (x[~bare] for x in (of, p, low, high, chunks))
    if len(p):
        order, common = _sorted_common(symbol, left, window)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        new = np.append(True, (np.diff(low) != 0) | (np.diff(chunks) != 0))
        run = np.cumsum(new) - 1
        start, shared = _intervals(common, rank[low[new]], chunks[new])
        some = shared[run]
        of, p, low, high, run = of[some], p[some], low[some], high[some], run[some]
        key = start[run].astype(np.uint64) * np.uint64(window + 1) + (cuts[low] - p).astype(np.uint64)
        key = mix64(mix64(key) + rolling.of(p, cuts[low])) + rolling.of(cuts[high], p + window)
        found.append(_twice(mix64(key) ^ group[of].view(np.uint64), p, data, window))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _by_bytes(data: np.ndarray, of: np.ndarray, p: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Places among the windows p of stretches `of` that occur again in their group, by the suffix array of their bytes."""
    new = np.append(True, (np.diff(p) != 1) | (of[1:] != of[:-1]))
    first, last = p[new], p[np.append(new[1:], True)]
    size = last - first + window
    part, at = _ragged(first, size + 1)
    ends = np.cumsum(size + 1) - 1
    symbol = data[np.minimum(at, len(data) - 1)].astype(np.int64) + 1
    symbol[ends] = 0
    order, common = _sorted_common(symbol, ends[part] - np.arange(len(part)), window)
    enough = common >= window
    start = np.concatenate([[0], np.cumsum(~enough)])
    key = np.empty(len(order), np.int64)
    key[order] = start
    starts = np.flatnonzero(ends[part] - np.arange(len(part)) >= window)
    owner = of[np.flatnonzero(new)][part[starts]]
    return _twice(mix64(key[starts].astype(np.uint64)) ^ group[owner].view(np.uint64), at[starts], data, window)


def repeated(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each position of data (within a stretch) occurs again in its group: in another stretch, or
    elsewhere in its own.

    Of equal stretches, two go to the suffix array and the others take over what it finds for these."""
    found = np.zeros(len(data), bool)
    length = np.diff(offsets)
    key = Rolling(data).of(offsets[:-1], offsets[1:]) ^ group.view(np.uint64)
    order = np.lexsort((np.arange(len(key)), key, group))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1]))
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of the stretches in order
    copies = order[place > 1]
    of = first[place > 1]
    same = length[copies] == length[of]
    for i in np.flatnonzero(same).tolist():
        a, b, n = offsets[copies[i]], offsets[of[i]], length[of[i]]
        same[i] = bool((data[a : a + n] == data[b : b + n]).all())
    kept = np.sort(np.concatenate([order[place <= 1], copies[~same]]))
    _, in_group, size = np.unique(group[kept], return_inverse=True, return_counts=True)
    kept = kept[(size[in_group] > 1) | (length[kept] >= 2 * window)]
    if len(kept):
        _, source = _ragged(offsets[kept], length[kept])
        at = np.concatenate([[0], np.cumsum(length[kept])])
        found[source[_by_chunks(data[source], at, group[kept], window)]] = True
    for copy, rep in zip(copies[same].tolist(), of[same].tolist(), strict=True):
        n = length[rep]
        found[offsets[copy] : offsets[copy] + n] = found[offsets[rep] : offsets[rep] + n]
    return found


SPANS = "doc_key long, start long, end long"


def _packed(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """doc_key (a number of the row), n_bytes, body (the text, compressed for its way) and the columns to carry, written
    once: so the numbers are the same for all who read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["text"]]
            rest = [batch[i] for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(t) for t in texts], pa.int64()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], [*names, "n_bytes", "body"])

    rows = docs.select("text", F.monotonically_increasing_id().alias("doc_key"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return cut(rows.mapInArrow(tidy(run), f"{kinds}, n_bytes long, body binary"))


def _opened(bodies: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of neighbouring texts, some STEP_BYTES of them at a time."""
    open_ = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    held = first = 0
    for row, body in enumerate(bodies):
        texts.append(open_.decompress(body.as_py()))
        held += len(texts[-1])
        if held >= STEP_BYTES or row + 1 == len(bodies):
            yield first, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            texts, held, first = [], 0, row + 1


def _anchor_rows(packed: DataFrame, window: int, gram: int) -> DataFrame:
    """name, doc_key, low, high for the anchors of each text; name null: bytes low..high are covered already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["doc_key"].to_numpy()
            for row, data, offsets in _opened(batch["body"]):
                text, name, low, high, start, end = anchors(data, offsets, window, gram)
                own = np.searchsorted(offsets, start, side="right") - 1
                doc = np.concatenate([text, own]).astype(np.int64)
                away = offsets[doc]
                names = pa.array(np.concatenate([name, np.zeros(len(start), np.int64)]), mask=np.repeat([False, True], [len(name), len(start)]))
                yield pa.RecordBatch.from_arrays([names, pa.array(keys[row + doc]), pa.array((np.concatenate([low, start]) - away).astype(np.int32)), pa.array((np.concatenate([high, end]) - away).astype(np.int32))], ["name", "doc_key", "low", "high"])

    return packed.select("doc_key", "body").mapInArrow(tidy(run), "name long, doc_key long, low int, high int")


def _stretches(packed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """name, times, doc_key, low, stretch (bytes low..high + window) of the wanted anchors."""
    lists = wanted.groupBy("doc_key").agg(F.collect_set(F.struct("name", "low", "high", "times")).alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, body, found in zip(batch["doc_key"].to_pylist(), batch["body"], batch["anchors"], strict=True):
                text = open_.decompress(body.as_py())
                for x in found.as_py():
                    out.append((x["name"], x["times"], key, x["low"], text[x["low"] : x["high"] + window]))
                    held += len(out[-1][-1])
                if held > 8 * STEP_BYTES:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["name", "times", "doc_key", "low", "stretch"])

    return packed.select("doc_key", "body").join(lists, "doc_key").mapInArrow(tidy(run), "name long, times long, doc_key long, low long, stretch binary")


def _compared(stretches: DataFrame, window: int) -> DataFrame:
    """SPANS of the windows that occur in another stretch of the same anchor: anchors are dealt to tasks, a task reads
    them as a stream, and compares the whole groups of about STEP_BYTES together."""

    def spans(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        name, key, low = (table[c].to_numpy() for c in ("name", "doc_key", "low"))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in table["stretch"].to_pylist()])]).astype(np.int64)
        data = np.frombuffer(b"".join(table["stretch"].to_pylist()), np.uint8)
        start, end = _runs(repeated(data, offsets, name, window))
        own = np.searchsorted(offsets, start, side="right") - 1
        away = low[own] - offsets[own]
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(start + away), pa.array(end - 1 + window + away)], ["doc_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            name = batch["name"].to_numpy()
            lengths = np.cumsum([len(b.as_buffer()) for b in batch["stretch"]])
            ends = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name))
            if held and held[-1]["name"][len(held[-1]) - 1].as_py() != name[0] and size >= STEP_BYTES:
                yield from spans(held)
                held, size = [], 0
            start = 0
            for end in ends[:-1].tolist():
                if size + lengths[end - 1] - (lengths[start - 1] if start else 0) >= STEP_BYTES:
                    yield from spans([*held, batch.slice(start, end - start)])
                    held, size, start = [], 0, end
            held.append(batch.slice(start))
            size += int(lengths[-1] - (lengths[start - 1] if start else 0))
        if held:
            yield from spans(held)

    dealt = stretches.select("name", "doc_key", "low", "stretch").repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(tidy(run), SPANS)


def _split(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (name, doc_key, low, stretch, start, known) of groups that are too large for one task, as rows of smaller groups.

    All windows of a group hold the same `known` bytes, in a stretch from `start` on (-1: the anchor's, to be looked for).
    The bytes that a window has besides lie to the left of these for one half or more, or to the right for more than
    half. By that, windows are told apart, with so many of those bytes more known: the new group's name is their hash.
    Halves of halves end with whole windows, so no group of different stretches stays large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, doc, low, stretch, start, known in zip(*(batch[c].to_pylist() for c in ("name", "doc_key", "low", "stretch", "start", "known")), strict=True):
                body = np.frombuffer(stretch, np.uint8)
                rolling = Rolling(body)
                if start < 0:
                    start = int(np.flatnonzero(rolling.all(gram).view(np.int64) == name)[0])
                rest, last = window - known, len(body) - window
                left = -(-rest // 2)
                right = rest - left + 1
                for side, first, final, at, size in ((1, 0, min(last, start - left), start - left, known + left), (2, max(0, start - left + 1), last, start, known + right)):
                    if first <= final and size <= window:
                        told = mix64(rolling.of(np.array([at]), np.array([at + size])) + np.uint64(side))
                        told = mix64(told ^ np.array([name], np.int64).view(np.uint64))
                        out.append((int(told.view(np.int64)[0]), doc, low + first, stretch[first : final + window], at - first, size))
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "doc_key", "low", "stretch", "start", "known"])

    return rows.mapInArrow(tidy(run), "name long, doc_key long, low long, stretch binary, start int, known int")


def _hot(stretches: DataFrame, window: int, gram: int, hot: int) -> list[DataFrame]:
    """SPANS as _compared, for anchors that occur so often that one task should not see all their stretches. Equal stretches
    repeat each other; one of each goes on, to _compared in groups of up to `hot`, and larger groups are split."""
    rows = stretches.select("name", "doc_key", "low", "stretch", F.lit(-1).alias("start"), F.lit(gram).alias("known"))
    found: list[DataFrame] = []
    while True:
        rows = cut(rows.withColumn("same", F.md5(F.concat(F.col("name").cast("string").cast("binary"), F.col("stretch")))))
        one = F.first(F.struct("name", "doc_key", "low", "stretch", "start", "known"))
        kinds = cut(rows.groupBy("same").agg(F.count("*").alias("n"), one.alias("one")))
        copies = rows.join(kinds.where("n > 1").select("same"), "same")
        found.append(copies.select("doc_key", F.col("low").alias("start"), (F.col("low") + F.octet_length("stretch")).alias("end")))
        kinds = kinds.select("one.*")
        sizes = kinds.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
        found.append(_compared(kinds.join(sizes.where(F.col("n") <= hot), "name"), window))
        large = cut(kinds.join(sizes.where(F.col("n") > hot).select("name"), "name"))
        if not large.limit(1).count():
            return found
        rows = _split(large, window, gram)


def repeated_spans(packed: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """SPANS whose union are the bytes of each document that a string of `window` bytes covers which also starts
    anywhere else."""
    rows = cut(_anchor_rows(packed, window, gram))
    found = rows.where("name is null").select("doc_key", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("end"))
    named = rows.where("name is not null")
    twice = named.groupBy("name").agg(F.count("*").alias("times")).where("times > 1")
    stretches = cut(_stretches(packed, named.join(twice, "name"), window))
    parts = [_compared(stretches.where(F.col("times") <= hot), window)]
    often = stretches.where(F.col("times") > hot)
    if often.limit(1).count():
        parts += _hot(often, window, gram, hot)
    for part in parts:
        found = found.unionByName(part)
    return found


def dedup(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, gram: int = GRAM, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """The columns of `carry`, n_bytes, n_removed, n_spans and kept (the bytes that remain) for each row of documents.
    as_text: kept is text; what a cut has left of a character goes, too.

    Anchors whose hash occurs once in the corpus end there. For the others, the stretch of bytes around each is
    dealt by anchor, and _compared finds the windows that occur again from intervals of suffix arrays made by linear
    grouping (gsaca); their bytes confirm it. Groups of more than `hot` stretches are split by further bytes first.
    Windows that repeat their neighbours in a text (periods) are told by comparing the text with itself, shifted.
    Hashes deal work out; bytes decide. Documents and anchors travel, texts compressed.

    Null text: empty. Strings never cross documents; a document may repeat itself, also with overlaps. Rows of equal
    doc_id and text are documents that repeat each other. Null doc_id: as any other. Empty table: no rows. Other
    columns are ignored unless carried."""
    packed = _packed(docs, carry)
    spans = repeated_spans(packed.select("doc_key", "body"), window, gram, hot)
    spans = spans.groupBy("doc_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_key", "key")
    joined = packed.join(spans, F.col("doc_key") == F.col("key"), "left").select(*carry, "n_bytes", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, runs = [], [], []
            for body, found, size in zip(batch["body"], batch["spans"], batch["n_bytes"].to_pylist(), strict=True):
                text = open_.decompress(body.as_py())
                if found.is_valid:
                    change = np.zeros(size + 1, np.int64)
                    starts, ends = (found.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(change, starts, 1)
                    np.add.at(change, ends, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    runs.append(len(_runs(gone)[0]))
                    removed.append(int(gone.sum()))
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                else:
                    runs.append(0)
                    removed.append(0)
                    kept.append(text)
            rest = [batch[c] for c in (*carry, "n_bytes")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], [*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType([joined.schema[c] for c in carry]))
    return joined.mapInArrow(tidy(run), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
