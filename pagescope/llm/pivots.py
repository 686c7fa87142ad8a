"""Embedding near-duplicates: a pivot-permutation index. Vectors are described by their nearest pivots in order, retrieved
through inverted lists of pivots with counts of shared pivots, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .components import components
from .vectors import matrix, unit, usable, with_key

#: Pivots: so many times the square root of the number of different vectors, within these bounds.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2, 256, 16384
#: Nearest pivots that describe a vector, in order; the first ones of them, in whose lists it is; and pivots that two
#: vectors share at least to be candidates.
NEAREST, LISTED, SHARED = 16, 6, 5
#: Vectors of one block of a list, and rows of one step inside.
BLOCK, STEP = 4096, 1024
#: Columns that name a block of a list.
PLACE = ("label", "dim", "list", "low", "high")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal PLACE, which lie together, list by list."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for c in PLACE:
            column = batch[c]
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and held[0][c][0].as_py() != column[0].as_py()
        edges = [*np.flatnonzero(new).tolist(), len(batch)]
        start = 0
        for end in edges:
            if held and end and start == 0 and not new[0]:
                held.append(batch.slice(0, end))
            elif end > start:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held = [batch.slice(start, end - start)]
            start = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _incidence(pivots: np.ndarray) -> np.ndarray:
    """One row for each row of pivots (-1: none), one column for each pivot that occurs."""
    known, at = np.unique(pivots, return_inverse=True)
    found = np.zeros((len(pivots), len(known)), np.float32)
    np.put_along_axis(found, at.reshape(pivots.shape), 1, 1)
    return found[:, known >= 0]


def _pairs(table: pa.Table, listed: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, which pairs count here, permutations): of a list block, some rows at a time against all. A pair counts in
    the list of the smallest pivot that both have among their first ones, and once among blocks."""
    size = pc.list_value_length(table["permutation"])[0].as_py()
    permutation = table["permutation"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
    pivot, own = table["list"][0].as_py(), table["own"].to_numpy()
    first = permutation[:, :listed]
    before = _incidence(np.where(first < pivot, first, -1))
    across = table["low"][0].as_py() != table["high"][0].as_py()
    for at in range(0, len(own), STEP):
        s = slice(at, at + STEP)
        counts = before[s] @ before.T == 0
        if across:
            counts &= own[s, None] != own[None, :]
        counts[np.arange(len(counts)), np.arange(at, at + len(counts))] = False
        yield s, counts, permutation


def _with_candidates(table: pa.Table, listed: int, shared: int) -> np.ndarray:
    """Rows of a list block that share `shared` pivots or more with another."""
    found = np.zeros(len(table), bool)
    whole = None
    for s, counts, permutation in _pairs(table, listed):
        whole = _incidence(permutation) if whole is None else whole
        found[s] = (counts & (whole[s] @ whole.T >= shared)).any(1)
    return found


def _linked(table: pa.Table, listed: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a list block: how many vectors it is linked with here, and the first row that links here reach."""
    x, copies = unit(matrix(table["vector"])), table["copies"].to_numpy()
    linked = np.zeros((len(x), len(x)), bool)
    for s, counts, _ in _pairs(table, listed):
        linked[s] = counts & (x[s] @ x.T >= least)
    linked |= linked.T  # rounding may differ
    links, label = linked @ copies, np.arange(len(x))
    while True:
        low = label.copy()
        for at in range(0, len(x), STEP):
            low[at : at + STEP] = np.minimum(label[at : at + STEP], np.where(linked[at : at + STEP], label, len(x)).min(1, initial=len(x)))
        low = low[low]
        if (low == label).all():
            return links, label
        label = low


def _in_blocks(postings: DataFrame) -> DataFrame:
    """Rows (label, dim, list, class and others) as blocks of lists: low and high are two blocks of a list, or one twice,
    own is the row's. Lists of one row go."""
    key = ["label", "dim", "list"]
    sizes = postings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("class", "list"), F.col("blocks")).cast("int")
    rows = postings.join(sizes, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")
    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE)


def near_vectors(vectors: DataFrame, least: float = 0.93, near: int = NEAREST, listed: int = LISTED, shared: int = SHARED, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; links: equal labels and cosine >= least.

    Copies are one class, compared once. The pivots are a sample of the different vectors, more of them for more
    vectors, at most MOST_PIVOTS. Each class is described by its `near` nearest pivots in order, and posted to the
    inverted lists of the first `listed` of them, with its permutation and without its vector. In a list, classes that
    share `shared` pivots or more with another are candidates; only their vectors are fetched, to the lists where they
    are, and compared. Lists of more than BLOCK classes are compared in blocks. A pair counts in one list, so links are
    counted once. A list gives for each class its number of links and one link towards its component, not the pairs.
    exact: one list for each label and no permutations, so that every pair is compared.

    Vectors that are null, zero or hold null or non-finite components, null labels and null ids link with nothing
    (a null vec_id: component_id null, kept). Vectors of other dimensions are not compared. Repeated rows are
    copies, linked with each other. Rows of equal vec_id are one node. Empty table: no rows. Other columns are
    ignored."""
    spark = vectors.sparkSession
    rows = cut(with_key(vectors.where("label is not null and vec_id is not null"), "vec_id", "label"))
    label = rows.schema["label"].dataType.simpleString()
    grouped = rows.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("dim").alias("dim"))
    classes = cut(grouped.withColumn("class", F.monotonically_increasing_id()))  # numbered once, as they are written
    points: dict[int, np.ndarray] = {}
    for dim, n in ((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):
        most = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(PIVOTS_PER_ROOT * n**0.5)))))
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(most).select("vector").collect()
        points[dim] = unit(np.unique(np.array([r["vector"] for r in sample], np.float64), axis=0))
    held = spark.sparkContext.broadcast(points)  # at most MOST_PIVOTS vectors of a dimension

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if exact or len(held.value[dim]) < near:  # one list for all
                    ranked = np.tile(np.arange(near), (len(part), 1))
                else:
                    away = -(unit(matrix(part["vector"])) @ held.value[dim].T)
                    few = np.argpartition(away, near - 1, 1)[:, :near]
                    ranked = np.take_along_axis(few, np.argsort(np.take_along_axis(away, few, 1), 1, kind="stable"), 1)
                flat = pa.array(ranked.astype(np.int32).ravel())
                order = pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, near, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part["class"], part["label"], part["dim"], order], ["class", "label", "dim", "permutation"])

    described = classes.select("class", "label", "dim", "vector").mapInArrow(tidy(describe), f"class long, label {label}, dim int, permutation array<int>")
    described = cut(described)
    posted = described.select("*", F.explode(F.slice("permutation", 1, 1 if exact else listed)).alias("list"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            kept = table.filter(pa.array(_with_candidates(table, listed, shared)))
            yield from kept.select(["class", "list"]).to_batches()

    if not exact:
        wanted = _in_blocks(posted).mapInArrow(tidy(candidates), "class long, list int").distinct()
        posted = described.join(wanted, "class")
    members = posted.join(classes.select("class", "copies", "vector", "rep"), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            links, first = _linked(table, listed, least)
            has = np.flatnonzero(links)
            rep = table["rep"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table["class"].to_numpy()[has], links[has], rep[has], rep[first[has]])], ["class", "links", "a", "b"])

    found = cut(_in_blocks(members).mapInArrow(tidy(compare), "class long, links long, a long, b long"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    several = rows.groupBy("vec_id").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min("label").alias("s"), F.max("label").alias("t")).where("x <> y or s <> t").select("vec_id")
    known = classes.select("label", "key", "class", "rep", "copies")
    same = rows.join(several, "vec_id", "left_semi").join(known, ["label", "key"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    parts = components(found.select("a", "b").unionByName(same))
    numbered = known.join(counts, "class", "left").join(parts, F.col("rep") == F.col("node"), "left")
    result = numbered.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.select("vec_id", "label", "key").join(cut(result), ["label", "key"]).select("vec_id", "n_links", "component_id")
    able = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rest = vectors.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
