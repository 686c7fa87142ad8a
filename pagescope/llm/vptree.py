"""Nearest neighbours: vantage-point trees, one per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, tidy
from .vectors import cosine, matrix, scaled, unit, usable

#: Vectors of a shard, about; of a leaf of its tree at most.
SHARD_ROWS, LEAF = 8192, 512
#: Shards at most (beyond that many times SHARD_ROWS vectors, shards grow), and vectors of the driver's sample for each.
MOST_SHARDS, SAMPLED = 8192, 16
#: A branch is left out if it lies further from the query's sphere than 1/FACTOR of its radius; 1 is exact.
FACTOR = 4.0
#: What rounding can change in a cosine and in a distance of unit vectors.
COSINE_SLACK, DISTANCE_SLACK = 1e-12, 1e-7


def _distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def _reach(kth: np.ndarray, factor: float) -> np.ndarray:
    """How far beyond a boundary a branch is searched, for the k-th best cosine so far (-inf: none yet)."""
    return np.where(np.isneginf(kth), np.inf, _distances(np.maximum(kth, -1.0)) / factor + DISTANCE_SLACK)


class Tree:
    """Vantage-point tree of distinct directions under the distance of unit vectors, which orders them as their cosine
    does. first and second: the two smallest ids of each row, second -1 where there is one id only."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, second: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.vectors, self.units, self.first, self.second, self.leaf = vectors, unit(vectors), first, second, leaf
        self.dice = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        point = int(rows[self.dice.integers(len(rows))])
        distance = _distances(self.units[rows] @ self.units[point])
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        radius = (distance[order[half - 1]] + distance[order[half]]) / 2
        return point, float(radius), self._build(rows[order[:half]]), self._build(rows[order[half:]])

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of up to k best rows for each query, padded with -1 and -inf: by cosine, then by the smallest
        id that isn't the query's; rows that are the query's alone are left out. All queries walk the tree together.
        floor: cosines that k others are known to reach."""
        n = len(queries)
        self.k, self.factor, self.queries, self.query_units, self.ids = k, factor, queries, unit(queries), ids
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.best, self.score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        alone = np.sort(self.first[self.second < 0])
        self.own = int((np.searchsorted(alone, ids, "right") - np.searchsorted(alone, ids)).max(initial=0))
        if len(self.vectors) and n:
            self._visit(self.root, np.arange(n))
        return self.best, self.score

    def _kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[who], self.score[who, -1])

    def _offer(self, who: np.ndarray, rows: np.ndarray) -> None:
        near = self.query_units[who] @ self.units[rows].T
        low = self._kth(who)
        most = self.k + self.own
        if len(rows) > most:
            low = np.maximum(low, np.partition(near, len(rows) - most, 1)[:, len(rows) - most])
        q, row = np.nonzero(near >= (low - COSINE_SLACK)[:, None])
        q, row = who[q], rows[row]
        other = np.where(self.first[row] == self.ids[q], self.second[row], self.first[row])
        alone = (self.first[row] == self.ids[q]) & (self.second[row] < 0)
        q, row, other = q[~alone], row[~alone], other[~alone]
        if not len(q):
            return
        score = cosine(self.queries[q], self.vectors[row])
        again = np.unique(q)
        held = self.best[again]
        old_q, old_at = np.nonzero(held >= 0)
        old = held[old_q, old_at]
        old_other = np.where(self.first[old] == self.ids[again[old_q]], self.second[old], self.first[old])
        score = np.concatenate([score, self.score[again][old_q, old_at]])
        q, row, other = np.concatenate([q, again[old_q]]), np.concatenate([row, old]), np.concatenate([other, old_other])
        order = np.lexsort((other, -score, q))
        q, row, score = q[order], row[order], score[order]
        start = np.searchsorted(q, q)
        place = np.arange(len(q)) - start
        kept = place < self.k
        self.best[again], self.score[again] = -1, -np.inf
        self.best[q[kept], place[kept]], self.score[q[kept], place[kept]] = row[kept], score[kept]

    def _visit(self, node: tuple, who: np.ndarray) -> None:
        if len(node) == 1:
            self._offer(who, node[0])
            return
        point, radius, inner, outer = node
        gap = _distances(self.query_units[who] @ self.units[point]) - radius
        for first, second, side in ((inner, outer, gap <= 0), (outer, inner, gap > 0)):
            mine = who[side]
            if not len(mine):
                continue
            self._visit(first, mine)
            if len(left := mine[np.abs(gap[side]) <= _reach(self._kth(mine), self.factor)]):
                self._visit(second, left)


class Upper:
    """The tree above the shards: vantage points and radii of a sample's medians; node i has the children 2i + 1 (inside)
    and 2i + 2. Its leaves are the shards. Small: a point for each shard."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, nodes = levels, (1 << levels) - 1
        self.points, self.radius = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
        parts = {0: np.arange(len(sample))}
        for i in range(nodes):
            rows = parts.pop(i)
            if len(rows):
                self.points[i] = sample[rows[0]]
                distance = _distances(sample[rows] @ sample[rows[0]])
                order = np.argsort(distance, kind="stable")
                half = max(1, len(rows) // 2)
                self.radius[i] = (distance[order[half - 1]] + distance[order[min(half, len(rows) - 1)]]) / 2
                rows = rows[order]
            parts[2 * i + 1], parts[2 * i + 2] = rows[: len(rows) // 2], rows[len(rows) // 2 :]

    def _gaps(self, units: np.ndarray, node: np.ndarray) -> np.ndarray:
        return _distances(np.einsum("ij,ij->i", units, self.points[node])) - self.radius[node]

    def shard(self, units: np.ndarray) -> np.ndarray:
        node = np.zeros(len(units), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (self._gaps(units, node) > 0)
        return node - (1 << self.levels) + 1

    def reached(self, units: np.ndarray, kth: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) of all shards that the relaxed inequality leaves."""
        who, node, reach = np.arange(len(units)), np.zeros(len(units), np.int64), _reach(kth, factor)
        for _ in range(self.levels):
            gap = self._gaps(units[who], node)
            inside, outside = gap <= reach[who], -gap <= reach[who]
            inside, outside = inside | (gap <= 0), outside | (gap > 0)
            who, node = np.concatenate([who[inside], who[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return who, node - (1 << self.levels) + 1


ROUTED = "dim int, shard int, kind int, vec_id long, kth double"
FOUND = "query_id long, vec_id long, score double"
#: What a shard's task gives back: found rows, and the queries with their k-th best cosine (vec_id null).
ANSWERED = f"{FOUND}, dim int, shard int"


def _few(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of each direction those of the `most` smallest distinct ids, each once."""
    _, which, times = np.unique(_bytes(scaled(x)), return_inverse=True, return_counts=True)
    if times.max(initial=0) <= most:
        return np.arange(len(ids))
    order = np.lexsort((ids, which))
    new = np.append(True, (which[order][1:] != which[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
    order = order[new]
    return order[np.arange(len(order)) - np.searchsorted(which[order], which[order]) < most]


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors found for each row of queries, by cosine.

    The upper levels of the vantage-point tree are made of a sample (SAMPLED vectors for each shard); each usable vector
    goes to the shard whose branch it is in, and a task builds that shard's tree. A query first searches its own
    shard, then those that its k-th best cosine so far, and the inequality relaxed by `factor`, leave. A task sorts its
    shard's vectors before the queries and answers them batch by batch: it holds one shard and one batch. The shards'
    answers meet per query. Of many copies of one direction, only those of the 2k smallest ids travel, batch by batch,
    which is all that any query can be given; so copies, however many, don't fill a shard.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. A
    query's own are the rows of its vec_id; rows of another equal vec_id count once, by the larger score. Vectors of
    other dimensions are no candidates. Ties go to the smaller vec_id. Fewer candidates than k: all. Empty table: no
    rows. Other columns are ignored."""
    spark = vectors.sparkSession

    def usable_rows(df: DataFrame) -> DataFrame:
        rows = df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).withColumn("dim", F.size("vector"))

    rows, asked = usable_rows(vectors), usable_rows(queries).distinct()
    kind = rows.schema["vector"].dataType.simpleString()
    uppers: dict[int, Upper] = {}
    for dim, n in ((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect()):
        levels = max(0, int(np.ceil(np.log2(min(MOST_SHARDS, max(1, n / shard_rows))))))
        if levels:
            few = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED << levels).select("vector")
            uppers[dim] = Upper(unit(np.array([r["vector"] for r in few.collect()], np.float64)), levels)
    held = spark.sparkContext.broadcast(uppers)  # a vector for each shard

    def place(batches: Iterator[pa.RecordBatch], asks: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(part["vector"])
                if not asks:
                    kept = _few(part["vec_id"].to_numpy(), x, 2 * k)
                    part, x = part.take(pa.array(kept)), x[kept]
                upper = held.value.get(dim)
                shard = upper.shard(unit(x)) if upper else np.zeros(len(x), np.int64)
                yield _routed(part, shard, np.full(len(x), -np.inf), int(asks))

    def place_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, with their own shard and k-th best cosine, to the other shards that these leave."""
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim in held.value:
                    kth, own = part["score"].to_numpy(), part["shard"].to_numpy()
                    who, shard = held.value[dim].reached(unit(matrix(part["vector"])), kth, factor)
                    who, shard = who[shard != own[who]], shard[shard != own[who]]
                    yield _routed(part.take(pa.array(who)), shard, kth[who], 1)

    def _routed(part: pa.RecordBatch, shard: np.ndarray, kth: np.ndarray, asks: int) -> pa.RecordBatch:
        n = len(part)
        columns = [part["dim"], pa.array(shard.astype(np.int32)), pa.array(np.full(n, asks, np.int32)), part["vec_id"], pa.array(kth), part["vector"]]
        return pa.RecordBatch.from_arrays(columns, ["dim", "shard", "kind", "vec_id", "kth", "vector"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, parts = None, None, []
        for batch in batches:
            where = np.stack([batch[c].to_numpy() for c in ("dim", "shard", "kind")], 1)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                *at, asks = where[start].tolist()
                if at != now:
                    now, shard, parts = at, None, []
                part = batch.slice(start, end - start)
                if not asks:
                    parts.append((part["vec_id"].to_numpy(), matrix(part["vector"])))
                    continue
                shard = shard or _Shard(parts, part["vector"].type)
                yield from shard.answer(part, k, factor, at)

    routed = cut(rows.mapInArrow(tidy(lambda b: place(b, False)), f"{ROUTED}, vector {kind}"))
    home = asked.mapInArrow(tidy(lambda b: place(b, True)), f"{ROUTED}, vector {kind}")

    def answered(asks: DataFrame) -> DataFrame:
        dealt = routed.unionByName(asks).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return cut(dealt.mapInArrow(tidy(answer), f"{ANSWERED}, vector {kind}"))

    first = answered(home)
    found = first.where("vec_id is not null")
    if uppers:
        bounds = first.where("vec_id is null").select(F.col("query_id").alias("vec_id"), "score", "dim", "shard", "vector")
        found = found.unionByName(answered(bounds.mapInArrow(tidy(place_again), f"{ROUTED}, vector {kind}")).where("vec_id is not null"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Shard:
    """A shard's tree over its distinct directions, and the distinct ids of each, ascending."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType):
        self.kind, self.tree = kind, None
        if not parts:
            return
        ids, x = np.concatenate([p[0] for p in parts]), scaled(np.concatenate([p[1] for p in parts]))
        _, first, which = np.unique(_bytes(x), return_index=True, return_inverse=True)
        order = np.lexsort((ids, which))
        new = np.append(True, (which[order][1:] != which[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
        self.ids, owner = ids[order][new], which[order][new]
        self.start = np.searchsorted(owner, np.arange(len(first) + 1))
        second = np.full(len(first), -1, np.int64)
        several = np.flatnonzero(np.diff(self.start) > 1)
        second[several] = self.ids[self.start[several] + 1]
        # Ids may be negative: a row's second id is told by place in the order of all ids, -1 stays free.
        self.known = np.unique(self.ids)
        second[several] = np.searchsorted(self.known, second[several])
        self.tree = Tree(x[first], np.searchsorted(self.known, self.ids[self.start[:-1]]), second)

    def answer(self, asked: pa.RecordBatch, k: int, factor: float, at: list[int], step: int = 512) -> Iterator[pa.RecordBatch]:
        """Found rows and the bounds of a batch of queries, as ANSWERED and vector."""
        for begin in range(0, len(asked), step):
            part = asked.slice(begin, step)
            who, x = part["vec_id"].to_numpy(), scaled(matrix(part["vector"]))
            floor = part["kth"].to_numpy()
            query, ids, score = self._found(who, x, k, factor, floor) if self.tree else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            n = len(query)
            kth = np.full(len(who), -np.inf)
            order = np.lexsort((-score, query))
            place = np.arange(n) - np.searchsorted(query[order], query[order])
            last = order[place == k - 1]
            kth[query[last]] = score[last]
            kth = np.maximum(kth, floor)
            columns = [
                pa.array(np.concatenate([who[query], who])), pa.array(np.concatenate([ids, np.zeros(len(who), np.int64)]), mask=np.arange(n + len(who)) >= n), pa.array(np.concatenate([score, kth])),
                pa.array(np.full(n + len(who), at[0], np.int32)), pa.array(np.full(n + len(who), at[1], np.int32)), pa.concat_arrays([pa.nulls(n, self.kind), part["vector"]]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "dim", "shard", "vector"])

    def _found(self, who: np.ndarray, x: np.ndarray, k: int, factor: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine): of each query's best rows the k smallest ids but its own; at least k ids, if there are."""
        known = np.searchsorted(self.known, who)
        mine = np.minimum(known, len(self.known) - 1)
        own = np.where(self.known[mine] == who, mine, len(self.known))
        out: list[tuple[int, int, float]] = []
        left, wide = np.arange(len(who)), k
        while len(left):
            rows, scores = self.tree.search(x[left], own[left], wide, factor, floor[left])
            short = []
            for i, found, cosines in zip(left.tolist(), rows.tolist(), scores.tolist(), strict=True):
                offered = []
                for row, score in zip(found, cosines, strict=True):
                    if row >= 0:
                        ids = self.ids[self.start[row] : self.start[row + 1]][: 2 * k + 1]
                        offered += [(i, int(v), score) for v in ids[ids != who[i]]]
                if found[-1] >= 0 and len({v for _, v, _ in offered}) < k:  # ids with several vectors took the places of others
                    short.append(i)
                else:
                    out += _distinct(offered, k)
            left, wide = np.array(short, np.int64), 2 * wide
        query, ids, score = (np.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else ([], [], []), (np.int64, np.int64, np.float64), strict=True))
        return query, ids, score


def _distinct(offered: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """The k best of the offered, each id once; they come by row, best first, ids ascending."""
    best: dict[int, tuple[int, int, float]] = {}
    for one in sorted(offered, key=lambda x: (-x[2], x[1])):
        best.setdefault(one[1], one)
        if len(best) == k:
            break
    return list(best.values())
