"""Exact top-k search by inner product: a ball tree per shard, branch and bound, the k-th score shared between rounds.

Rows are dealt to shards by nearness to one of at most SHARDS centres, chosen from a sample of bounded size, and a shard's
ball (centre, exact radius) is broadcast; a shard of many rows is cut into parts, which have its ball. The most that a
shard can hold for a query is q.centre + |q| * radius. A query meets the shards in rounds, those of the greatest bounds
first: one, then ROUND, then the others. Between rounds the k-th score found so far in all shards is its floor, and it
goes to no shard whose bound is below. A shard's task builds a ball tree over its vectors (memory: PART rows) and
streams the queries; nodes stand in a priority queue by bound, and the search ends where the bound is below the k-th score,
its own or shared. Ties with the k-th score are never dropped.

Defined cases: vectors that are null or hold null or non-finite components, or are of a length other than the most frequent
one, take no part; zero vectors do; repeated rows are one candidate; fewer candidates than asked for give fewer rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import best, matrix, sampled, top, usable

#: Rows of a shard, about, and most shards; rows that one task holds at once; rows of a leaf.
SHARD, SHARDS, PART, LEAF = 8192, 4096, 65536, 64
#: Vectors, at most, of which shard centres are chosen; shards of the second round.
SAMPLE, ROUND = 20_000, 8


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


class Dots:
    """Exact integer inner products of whole-numbered matrices: in doubles where no partial sum can reach 2**53."""

    def __init__(self, v: np.ndarray):
        self.v, self.most = v, float(np.abs(v).max(initial=0))

    def __call__(self, q: np.ndarray, rows=slice(None)) -> np.ndarray:
        if self.most * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53:
            return (self.v[rows] @ q).astype(np.int64)
        whole = [int(x) for x in q]
        return np.array([sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in self.v[rows]], np.int64)


class BallTree:
    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.arange(len(v))
        self.nodes: list[tuple[int, int]] = []  # ranges of order
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(0, len(v), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.nodes)
            x = v[order[a:b]]
            centre = x.mean(axis=0)
            off = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.nodes.append((a, b))
            self.children.append(None)
            centres.append(centre)
            radii.append(off.max())
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if b - a > LEAF and radii[-1] > 0:
                far = x[off.argmax()]  # split by nearness to two far points, at the middle
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                side = x @ (other - far)
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.dots = ids[order], Dots(v[order])

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best in this shard that reach floor."""
        bound = _upper(self.centres, self.radii, q)
        heap = [(-float(bound[0]), 0)]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap:
            most, node = heapq.heappop(heap)
            if floor is not None and -most < floor:
                break
            if self.children[node] is not None:
                for c in self.children[node]:
                    heapq.heappush(heap, (-float(bound[c]), c))
                continue
            a, b = self.nodes[node]
            own, score = self.ids[a:b], self.dots(q, slice(a, b))
            good = own != query_id
            if floor is not None:
                good &= score >= floor
            if good.any():
                ids, scores = np.concatenate([ids, own[good]]), np.concatenate([scores, score[good]])
                t = top(ids, scores, k, True)
                ids, scores = ids[t], scores[t]
                if len(ids) == k:
                    floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        return ids, scores


_FOUND = "query_id long, vec_id long, score long"


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample or fewer, each far from those before (farthest first); all differ."""
    at = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    away = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < n and away.max() > 0:
        at.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _upper(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The most that a vector in each ball can score against q, never too low for rounding."""
    norm = float(np.sqrt((q * q).sum()))
    bound = centres @ q + norm * radii
    return bound + 1e-9 * (np.abs(bound) + norm * radii) + 1e-6 * (1 + norm)


def top_inner_products(df: DataFrame, column: str, query_where: str, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest inner product of floor(scale * vector)."""
    rows, n, d = usable(df, column, zero=True)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = sampled(rows, n, SAMPLE).select("vec").toArrow()["vec"]
    centres = _centres(quantised(matrix(sample, d), scale), max(1, min(SHARDS, n // SHARD)))
    held = spark.sparkContext.broadcast(centres)

    def deal(batches):
        c = held.value
        half = (c * c).sum(axis=1) / 2
        for batch in batches:
            x = quantised(matrix(batch.column("vec"), d), scale)
            shard = (half - x @ c.T).argmin(axis=1)
            off = np.sqrt(((x - c[shard]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(off), *batch.columns], ["shard", "off", *batch.schema.names])

    vec = rows.schema["vec"].dataType.simpleString()
    dealt, _ = staged(rows.mapInArrow(deal, f"shard int, off double, vec_id long, vec {vec}"))
    radii, parts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in dealt.groupBy("shard").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect():  # at most SHARDS rows
        radii[r["shard"]], parts[r["shard"]] = r["off"], -(-r["n"] // PART)
    balls = spark.sparkContext.broadcast((centres, radii, parts))
    split = F.lit(0)
    if parts.max() > 1:
        many = spark.createDataFrame([(int(s), int(p)) for s, p in enumerate(parts) if p > 1], "shard int, parts int")
        dealt = dealt.join(F.broadcast(many), "shard", "left")
        split = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")
    stored = dealt.select("shard", split.alias("part"), F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    queries, _ = staged(rows.where(query_where).dropDuplicates(["vec_id"]))

    def ask(first: int, last: int):
        """Sends each query to its shards number first to last - 1 by bound that reach its floor, in all their parts."""

        def run(batches):
            centres, radii, parts = balls.value
            for batch in batches:
                row, shard = [], []
                for r, (x, floor) in enumerate(zip(quantised(matrix(batch.column("vec"), d), scale), batch.column("floor").to_pylist(), strict=True)):
                    bound = np.where(parts > 0, _upper(centres, radii, x), -np.inf)
                    order = np.argsort(-bound, kind="stable")[first:last]
                    order = order[bound[order] >= (floor if floor is not None else -np.finfo(float).max)]
                    row.append(np.full(len(order), r))
                    shard.append(order)
                row, shard = np.concatenate(row), np.concatenate(shard)
                times = parts[shard]
                part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                row, shard = np.repeat(row, times), np.repeat(shard, times)
                taken = batch.select(["vec_id", "vec", "floor"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), *taken.columns], ["shard", "part", "kind", "vec_id", "vec", "floor"])

        return run

    def search(batches):
        now, held_, tree = None, [], None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
            ids, floor = batch.column("vec_id").to_numpy(), batch.column("floor").to_pylist()
            x = quantised(matrix(batch.column("vec"), d), scale)
            cut = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)))
            for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
                if (shard[a], part[a]) != now:
                    now, held_, tree = (shard[a], part[a]), [], None
                if kind[a] == 0:
                    held_.append((ids[a:b], x[a:b]))
                    continue
                if tree is None and held_:
                    own, v = (np.concatenate(c) for c in zip(*held_, strict=True))
                    order = np.lexsort((*v.T, own))
                    own, v = own[order], v[order]
                    new = np.append(True, (own[1:] != own[:-1]) | (v[1:] != v[:-1]).any(axis=1))
                    tree, held_ = BallTree(own[new], v[new]), []
                found = [tree.search(int(ids[r]), x[r], k, floor[r]) for r in range(a, b)] if tree else []
                if found:
                    who = np.repeat(ids[a:b], [len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    best_so_far = None
    shards = int((parts > 0).sum())
    edges = sorted({0, 1, min(1 + ROUND, shards), shards})
    for first, last in zip(edges, edges[1:], strict=False):
        asked = queries.withColumn("floor", F.lit(None).cast("long"))
        if best_so_far is not None:
            floors = best_so_far.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            asked = queries.join(floors, "vec_id", "left")
        sent = asked.select("vec_id", "vec", "floor").mapInArrow(ask(first, last), f"shard int, part int, kind int, vec_id long, vec {vec}, floor long")
        keys = ["shard", "part"]
        met = stored.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(search, _FOUND)
        every = met if best_so_far is None else met.unionByName(best_so_far.drop("rank"))
        best_so_far = best(every, k, True)
        if last < shards:
            best_so_far, _ = staged(best_so_far)
    return best_so_far
