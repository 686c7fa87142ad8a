"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def balance(sizes: list[int], shards: int) -> list[int]:
    """Shard of each range: largest range first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    to = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        had, s = heapq.heappop(heap)
        to[i] = s
        heapq.heappush(heap, (had + sizes[i], s))
    return to


#: A range with so many times its share of bytes is overfull, and how often ranges are subdivided at most.
OVERFULL, MOST_TURNS = 2, 8


def _place(bounds: np.ndarray) -> Callable[[str], Column]:
    """Range of a key: the number of boundaries up to it."""

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int64))

    return range_of


def _subdivided(rows: DataFrame, bounds: np.ndarray, full: dict[int, int], most: int, samples: int, sampled: Callable[[DataFrame, Column, int], np.ndarray], turn: int) -> np.ndarray:
    """The boundaries, and more of them inside the ranges of `full` (bytes by range): quantiles of a new sample of the keys
    that these hold, with as many pieces as their bytes ask for."""
    pieces = {r: -(-size // most) for r, size in full.items()}
    own = rows.withColumn("range", _place(bounds)("key")).where(F.col("range").isin(list(full)))
    keys = sampled(own, F.col("size") * F.lit(float(samples * turn) / most), turn)
    at = np.searchsorted(bounds, keys, side="right")
    more = []
    for r, n in pieces.items():
        mine = keys[at == r]
        if len(mine):
            more.append(mine[np.arange(1, n) * len(mine) // n])
    return np.unique(np.concatenate([bounds, *more]))


def shard(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 128, samples_per_range: int = 32, parts_per_shard: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of documents.

    The key is a hash of the text, so equal texts lie together. A key sample with chances in proportion to size
    (at most about shards * ranges_per_shard * samples_per_range keys reach the driver) gives the boundaries of
    shards * ranges_per_shard ranges of about equal bytes. A key with more bytes than one range (at most as many
    as there are ranges, by their definition) is overfull and becomes a range of its own; one with more bytes than
    a shard's share divided by parts_per_shard becomes several, by row. Bytes are then counted for each range; a range
    with OVERFULL times its share is subdivided at the quantiles of a new sample of its keys, and so on. Whole ranges go
    to the shards, largest first, so that shards have near equal bytes. Equal texts thus share a shard unless their
    group is as large as that.

    Null text: no bytes, crc32 0. Null or repeated doc_id and repeated rows: each row is dealt by itself.
    Slots of a shard are gapless from 0: range by range, by key inside. Empty table: no rows. Other columns are
    ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")))
    ranges = shards * ranges_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // ranges)

    def sampled(of: DataFrame, chance: Column, seed: int) -> np.ndarray:
        dice = (F.pmod(F.xxhash64("row", F.lit(f"splitters{seed or ''}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return np.sort(np.array([r[0] for r in of.where(dice < chance).select("key").collect()], np.int64))

    sample = sampled(rows, F.col("size") * F.lit(float(ranges * samples_per_range) / max(1, total)), 0)
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample
    overfull = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    whole = max(1, total // (shards * parts_per_shard))
    parts = {r[0]: -(-r[1] // whole) for r in overfull.collect()}
    heavy = np.sort(np.array(list(parts), np.int64))
    count = np.array([parts[k] for k in heavy.tolist()], np.int64)
    light = rows.join(F.broadcast(spark.createDataFrame([(int(k),) for k in heavy], "key long")), "key", "left_anti") if len(heavy) else rows
    for turn in range(1, MOST_TURNS):
        filled = light.groupBy(_place(bounds)("key").alias("range")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * most)
        full = {r[0]: r[1] for r in filled.collect()}
        if not full:
            break
        bounds, had = _subdivided(light, bounds, full, most, samples_per_range, sampled, turn), len(bounds)
        if len(bounds) == had:
            break
    first = len(bounds) + 1 + np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    @F.pandas_udf("long")
    def range_of(key: pd.Series, row: pd.Series) -> pd.Series:
        k, at = key.to_numpy(), np.searchsorted(bounds, key.to_numpy(), side="right")
        if len(heavy):
            i = np.minimum(np.searchsorted(heavy, k), len(heavy) - 1)
            at = np.where(heavy[i] == k, first[i] + (row.to_numpy() * 2654435761 >> 7) % count[i], at)
        return pd.Series(at.astype(np.int64))

    ranged = rows.withColumn("range", range_of("key", "row"))
    found = ranged.groupBy("range").agg(F.sum("size"), F.count("*")).orderBy("range").collect()
    to, used, plan = balance([r[1] for r in found], shards), [0] * shards, []
    for r, s in zip(found, to, strict=True):
        plan.append((r[0], s, used[s]))
        used[s] += r[2]
    placed = F.broadcast(spark.createDataFrame(plan, "range long, shard int, before long"))  # a row for each range
    slot = F.row_number().over(W.partitionBy("range").orderBy("key", "doc_id", "row")) - 1
    return ranged.withColumn("slot", slot.cast("long")).join(placed, "range").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
