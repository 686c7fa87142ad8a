"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, shingle_sets, text_steps, tidy
from .components import components

#: Hash functions of a signature, at most 256, and rows of a band.
FUNCTIONS, BAND_ROWS = 100, 5
#: Pairs of one verification group; classes and shingles of one block of a bucket.
GROUP_PAIRS, BLOCK, BLOCK_SHINGLES = 1000, 2000, 400_000
#: Tells the second half of a set's name from the first.
CHECK_SEED = np.uint64(0xD1B54A32D192ED03)


def signatures(sets: np.ndarray, bounds: np.ndarray, functions: int = FUNCTIONS) -> np.ndarray:
    """SuperMinHash (Ertl 2017) of each set of hashes, as 16 bits for each function: (sets, functions) of uint16.

    Element e gives function p[j] the value j + r, for j = 0, 1, ... along e's own random permutation p, r from
    e and j; each function keeps the least value. The permutation is made as it is read (Fisher-Yates), for all
    elements at once, and a set stops at step j once all its values are at most j, as later ones are larger: a
    large set after a step or two. Ranks of an element exclude each other, hence the lower variance."""
    m, many = functions, len(bounds) - 1
    least = np.full(many * m, (m + 1) << 24, np.int64)
    owner = np.repeat(np.arange(many), np.diff(bounds))
    element, p = sets, None
    for j in range(m):
        x = mix64(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (j << 24) + (x >> np.uint64(40)).astype(np.int64)
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if p is None:
            at = k
        else:
            rows = np.arange(len(element))
            at = p[rows, k].astype(np.int64)
            p[rows, k] = p[:, j]
            p[:, j] = at
        np.minimum.at(least, owner * m + at, value)
        going = (least.reshape(many, m).max(1) > (j + 1) << 24)[owner] if len(owner) else np.zeros(0, bool)
        if not going.any():
            break
        if p is None:
            first = k[going]
            p = np.tile(np.arange(m, dtype=np.uint8), (len(first), 1))
            p[np.arange(len(first)), first] = 0
            p[:, 0] = first
        elif not going.all():
            p = p[going]
        element, owner = element[going], owner[going]
    return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype("<u2").reshape(many, m)


def described(docs: DataFrame, words: int, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, text_key, n_shingles, digest and check (together 128 bits that name the set) and signature (bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_steps(batch["text"]):
                sets, bounds = shingle_sets(data, offsets, words)
                size = np.diff(bounds)
                names = []
                for seed in (np.uint64(0), CHECK_SEED):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ seed))])
                    names.append(pa.array(mix64(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)).view(np.int64)))
                signed = signatures(sets, bounds, functions)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(size.astype(np.int64)), *names, pa.array([s.tobytes() for s in signed], pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "check", "signature"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, digest long, check long, signature binary")


def _bands(functions: int, rows: int) -> Column:
    width = 2 * rows
    return F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(functions // rows)])


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys whose full sets have 100 * intersection >= percent * union; texts: set_key, text.

    Partners b are dealt with their a, in groups of about GROUP_PAIRS; a task reads its groups as a stream, a's
    text first, and holds one set of a at a time. Texts travel only for sets that are in a pair."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    firsts = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("needs"))
    wanted = dealt.select("a", "salt", "b", F.col("b").alias("needs")).unionByName(firsts)
    rows = wanted.join(texts, F.col("needs") == F.col("set_key")).select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, salt = batch["a"].to_pylist(), batch["b"], batch["salt"].to_pylist()
            partner = b.is_valid().to_numpy(zero_copy_only=False)
            found: tuple[list[int], list[int]] = ([], [])
            for row, end, data, offsets in text_steps(batch["text"]):
                sets, bounds = shingle_sets(data, offsets, words)
                i = row
                while i < end:
                    if (a[i], salt[i]) != now:  # the text of a comes first
                        now, own = (a[i], salt[i]), sets[bounds[i - row] : bounds[i - row + 1]]
                        i += 1
                        continue
                    stop = i
                    while stop < end and (a[stop], salt[stop]) == now:
                        stop += 1
                    edges = bounds[i - row : stop - row + 1]
                    inside = sets[edges[0] : edges[-1]]
                    at = np.minimum(np.searchsorted(own, inside), max(0, len(own) - 1))
                    hit = np.concatenate([[0], np.cumsum(own[at] == inside)]) if len(own) else np.zeros(len(inside) + 1, np.int64)
                    both = hit[edges[1:] - edges[0]] - hit[edges[:-1] - edges[0]]
                    linked = (100 * both >= percent * (np.diff(edges) + len(own) - both)) & partner[i:stop]
                    for j in np.flatnonzero(linked).tolist():
                        found[0].append(a[i])
                        found[1].append(b[i + j].as_py())
                    i = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    dealt_rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt_rows.mapInArrow(tidy(run), "a long, b long").distinct()


def _packed(texts: DataFrame) -> DataFrame:
    """set_key and body: the text, compressed for its way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["set_key"], pa.array([squeeze.compress(t.as_py().encode()) for t in batch["text"]], pa.binary())], ["set_key", "body"])

    return texts.select("set_key", "text").mapInArrow(tidy(run), "set_key long, body binary")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of equal `names`, which lie together, group by group."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        place = np.stack([batch[c].to_numpy() for c in names], 1)
        edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            if held and place[start].tolist() != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = place[start].tolist()
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _across(rows: DataFrame, words: int, percent: int, functions: int, band_rows: int) -> DataFrame:
    """Links (a, b) that join classes of different components, of rows (bucket, band, head, set_key, component,
    n_shingles, signature, body). A bucket is compared in blocks of bounded size, in the task, on full sets; a pair
    in the first bucket that it shares only. Pairs whose sizes rule the threshold out, and pairs that links
    found in the block have joined meanwhile, are skipped. So a block emits fewer links than it has classes."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocked = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("set_key", "bucket"), F.col("blocks")).cast("int"))
    spread = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for table in _groups(batches, ("bucket", "low", "high")):
            key, part, size, own = (table[c].to_numpy() for c in ("set_key", "component", "n_shingles", "own"))
            band, head, alone = table["band"][0].as_py(), table["head"][0].as_py(), table["low"][0].as_py() == table["high"][0].as_py()
            signed = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(len(key), functions)
            sets: dict[int, np.ndarray] = {}

            def of(i: int, bodies: pa.ChunkedArray = table["body"], sets: dict[int, np.ndarray] = sets) -> np.ndarray:
                if i not in sets:
                    text = np.frombuffer(open_.decompress(bodies[i].as_py()), np.uint8)
                    sets[i] = shingle_sets(text, np.array([0, len(text)]), words)[0]
                return sets[i]

            label = np.unique(part, return_inverse=True)[1]
            found: list[tuple[int, int]] = []
            for i in range(len(key)):
                others = np.arange(i + 1, len(key))
                others = others[(label[others] != label[i]) & (alone | (own[others] != own[i]))]
                others = others[(key[others] != head) & (key[i] != head)]
                others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
                if not len(others):
                    continue
                same = signed[others] == signed[i]
                before = same[:, : band * band_rows].reshape(len(others), band, band_rows).all(2).any(1)
                others = others[~before]
                if not len(others):
                    continue
                mine = of(i)
                theirs = [of(j) for j in others.tolist()]
                ends = np.cumsum([len(x) for x in theirs])
                whole = np.concatenate(theirs)
                at = np.minimum(np.searchsorted(mine, whole), len(mine) - 1)
                hit = np.concatenate([[0], np.cumsum(mine[at] == whole)])
                both = hit[ends] - hit[np.concatenate([[0], ends[:-1]])]
                for j in others[100 * both >= percent * (size[others] + size[i] - both)].tolist():
                    if label[j] != label[i]:
                        found.append((int(key[i]), int(key[j])))
                        label[label == label[j]] = label[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = spread.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, functions: int = FUNCTIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents; links: 100 * intersection >= percent * union.

    Equal sets (by 128 bits) are one class, set_key its number. Each class is compared with the first class of each of its buckets (two classes
    share a bucket if the signatures agree on a band) on full sets; links join classes to components. Where a
    bucket then still has classes of several components, the pairs across components are compared too, in the task
    that has them, so that no link that a bucket shows is lost. Pairs within a component can't change it and are skipped. A pair at the
    threshold s shares no bucket with chance (1 - s**band_rows)**(functions/band_rows): 8e-6 for 0.85 and 5 of 100.

    Null or empty text, or one without words: size 0, linked with nothing. Null doc_id: linked with nothing,
    component_id null, kept. Rows of equal doc_id are one node with several texts. Repeated rows: as any equal
    sets. Empty table: no rows. Other columns are ignored."""
    slim = cut(described(docs, words, functions))
    usable = slim.where("doc_id is not null and n_shingles > 0")
    sets = usable.groupBy("digest", "check").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut(sets.select(F.monotonically_increasing_id().alias("set_key"), "digest", "check", "rep.doc_id", "rep.text_key", "n_shingles", "signature"))  # numbered once, as they are written
    buckets = classes.select("set_key", F.posexplode(_bands(functions, band_rows)).alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("set_key").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    shared = cut(buckets.join(heads, "bucket"))  # classes that meet others
    own_buckets = shared.groupBy("set_key").agg(F.collect_list(F.struct("band", "bucket", F.col("a").alias("head"))).alias("buckets"))
    pairs = cut(shared.where("a <> set_key").select("a", F.col("set_key").alias("b")).distinct())
    links = cut(verified(pairs, _texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("set_key"))), words, percent))
    rep = classes.select("set_key", "doc_id")
    name = F.struct("digest", "check")
    several = usable.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo <> hi").select("doc_id")
    named = classes.select("digest", "check", F.col("doc_id").alias("b"))
    own = usable.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "digest", "check").join(named, ["digest", "check"]).select("a", "b")

    def joined(found: DataFrame) -> DataFrame:
        """set_key, digest, check, component of each class."""
        ids = found.join(rep.select(F.col("set_key").alias("a"), F.col("doc_id").alias("x")), "a").join(rep.select(F.col("set_key").alias("b"), F.col("doc_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        parts = components(ids.unionByName(own))
        firsts = classes.select("set_key", "digest", "check", "doc_id")
        return cut(firsts.join(parts, F.col("doc_id") == F.col("node"), "left").select("set_key", "digest", "check", F.coalesce("component", "doc_id").alias("component")))

    labelled = joined(links)
    marked = own_buckets.join(labelled, "set_key").select("set_key", "component", F.inline("buckets"))
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("bucket")
    open_rows = marked.join(mixed, "bucket", "left_semi").groupBy("set_key", "component").agg(F.collect_list(F.struct("band", "bucket", "head")).alias("buckets"))
    open_rows = cut(open_rows)
    if open_rows.limit(1).count():
        told = classes.select("set_key", "n_shingles", "signature").join(_packed(_texts(docs, classes, open_rows)), "set_key")
        rows = open_rows.join(told, "set_key").select("set_key", "component", "n_shingles", "signature", "body", F.inline("buckets"))
        found = cut(_across(rows, words, percent, functions, band_rows))
        if found.limit(1).count():
            labelled = joined(links.unionByName(found))
    out = slim.join(labelled.drop("set_key"), ["digest", "check"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """set_key, text of the classes whose set_key is in `needed`."""
    wanted = classes.join(needed.select("set_key").distinct(), "set_key", "left_semi").select("set_key", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key"))).select("set_key", "text")
