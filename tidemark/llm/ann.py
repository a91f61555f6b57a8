"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a sample of at most SAMPLE vectors; every row is put into one of its leaves. A query walks the tree
with a priority queue by distance to the centres, which gives an order of leaves; how many of them it visits is calibrated:
for a set of queries the true neighbours are found by one brute-force pass, and the number of leaves is widened until
TARGET of them lie in leaves visited; a query goes on beyond that while its leaves hold too few rows. Leaf and query rows then meet by leaf; a leaf that holds many rows is cut into
chunks that every query of the leaf visits. Scores are exact Euclidean distances on the vectors as given.

Bounds: SAMPLE vectors and at most SAMPLE / 16 centres on the driver and in the broadcast. Beyond LEAF * SAMPLE / 16 rows
leaves grow with the table.

Defined cases: vectors that are null, zero or hold null or non-finite components, and vectors of a length other than the
most frequent one, take no part; rows that repeat a vec_id and its vector are one candidate; fewer candidates than asked
for give fewer rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import best, matrix, sampled, top, usable

SAMPLE = 40_000
#: Rows of a leaf, about; children of a node; rounds of Lloyd's iteration.
LEAF, BRANCH, ROUNDS = 256, 8, 6
#: Rows of a leaf that one task scores at once.
CHUNK = 2048
#: A walk goes on until its leaves hold this many times the rows asked for (distinct ids in a leaf are counted roughly).
ENOUGH = 2
#: Queries used to calibrate, and the share of true neighbours to be reached on them.
PROBES, TARGET = 64, 0.97


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, by the product formula: for ordering only."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


class KMeansTree:
    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        heap = [(-len(sample), 0, np.arange(len(sample)))]  # the fullest leaf is split next
        n = 1
        while heap and n < leaves:
            size, node, rows = heapq.heappop(heap)
            if -size < 2:
                break
            centres, part = self._means(sample[rows], min(BRANCH, -size, leaves - n + 1))
            if len(centres) < 2:
                continue  # all alike
            for k in range(len(centres)):
                self.centres.append(centres[k])
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                own = rows[part == k]
                heapq.heappush(heap, (-len(own), len(self.centres) - 1, own))
            n += len(centres) - 1
        del self.rng
        self.centres = np.array(self.centres)
        ends = [k for k, c in enumerate(self.children) if not c]
        self.leaf = {node: k for k, node in enumerate(ends)}

    def _means(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            part = distances(x, centres).argmin(axis=1)
            some = np.unique(part)
            centres = np.array([x[part == c].mean(axis=0) for c in some])
        part = distances(x, centres).argmin(axis=1)
        some, part = np.unique(part, return_inverse=True)
        return centres[some], part

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            own = np.array(self.children[node])
            part = distances(x[rows], self.centres[own]).argmin(axis=1)
            todo += [(int(c), rows[part == k]) for k, c in enumerate(own)]
        return out

    def order(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of the best-bin-first walk: visits of them, and on until they hold `least` rows of sizes."""
        near = ((self.centres - q) ** 2).sum(axis=1)
        heap, out, held = [(float(near[0]), 0)], [], 0
        while heap and (len(out) < visits or held < least):
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                out.append(self.leaf[node])
                held += 0 if sizes is None else int(sizes[out[-1]])
            for c in self.children[node]:
                heapq.heappush(heap, (float(near[c]), c))
        return out


def _calibrated(rows: DataFrame, queries: DataFrame, n_queries: int, tree, k: int, d: int) -> int:
    """Leaves to visit so that TARGET of the probes' true neighbours are seen."""
    probes = sampled(queries, n_queries, PROBES).toArrow()
    ids, x = probes["vec_id"].to_numpy(), matrix(probes["vec"], d)

    def scan(batches):
        for batch in batches:
            own, v = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"), d)
            near = distances(x, v)
            near[ids[:, None] == own] = np.inf
            leaf = tree.value.assign(v)
            for p in range(len(ids)):
                t = top(own, near[p], k, False)
                t = t[np.isfinite(near[p][t])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), p, np.int64)), pa.array(own[t]), pa.array(near[p][t]), pa.array(leaf[t])], ["query_id", "vec_id", "score", "leaf"])

    found = rows.mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
    true = best(found, k, False).join(found, ["query_id", "vec_id"]).select("query_id", "vec_id", "leaf").distinct().collect()  # PROBES * k rows
    leaves = len(tree.value.leaf)
    rank = {}
    for p in range(len(ids)):
        rank[p] = {leaf: r for r, leaf in enumerate(tree.value.order(x[p], leaves))}
    needed = sorted(rank[t["query_id"]][t["leaf"]] + 1 for t in true)
    return needed[min(len(needed) - 1, int(len(needed) * TARGET))] if needed else 1


_FOUND = "query_id long, vec_id long, score double"


def nearest(df: DataFrame, column: str, query_where: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that satisfies query_where."""
    rows, n, d = usable(df, column, zero=False)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(sampled(rows, n, SAMPLE).select("vec").toArrow()["vec"], d)
    tree = spark.sparkContext.broadcast(KMeansTree(sample, max(1, min(n // LEAF, len(sample) // 16))))
    queries = rows.where(query_where).dropDuplicates(["vec_id"])
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = _calibrated(rows, queries, n_queries, tree, k, d)

    def put(batches):
        for batch in batches:
            leaf = tree.value.assign(matrix(batch.column("vec"), d))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    vec = rows.schema["vec"].dataType.simpleString()
    indexed, _ = staged(rows.mapInArrow(put, f"leaf int, vec_id long, vec {vec}"))
    counts, kinds = np.zeros(len(tree.value.leaf), np.int64), np.zeros(len(tree.value.leaf), np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids")).collect():  # at most SAMPLE / 16 leaves
        counts[r["leaf"]], kinds[r["leaf"]] = r["n"], r["ids"]
    sizes = spark.sparkContext.broadcast((-(-counts // CHUNK), kinds))
    dealt = indexed.withColumn("part", F.lit(0))
    if counts.max() > CHUNK:
        many = spark.createDataFrame([(int(leaf), int(-(-c // CHUNK))) for leaf, c in enumerate(counts) if c > CHUNK], "leaf int, parts int")
        split = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = indexed.join(F.broadcast(many), "leaf", "left").select(*indexed.columns, split.alias("part"))

    def visit(batches):
        for batch in batches:
            x = matrix(batch.column("vec"), d)
            row, leaf, part = [], [], []
            for r in range(len(x)):
                for k_ in tree.value.order(x[r], visits, sizes.value[1], ENOUGH * (k + 1)):
                    for p in range(int(sizes.value[0][k_])):
                        row.append(r)
                        leaf.append(k_)
                        part.append(p)
            taken = batch.select(["vec_id", "vec"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), *taken.columns], ["leaf", "part", "query_id", "query"])

    asked = queries.mapInArrow(visit, f"leaf int, part int, query_id long, query {vec}")

    def score(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows_.num_rows and asked_.num_rows:
            own, v = rows_["vec_id"].to_numpy(), matrix(rows_["vec"], d)
            _, first = np.unique(np.column_stack([own.astype(np.float64), v]), axis=0, return_index=True)
            if len(first) < len(own):
                own, v = own[first], v[first]
            for q, x in zip(asked_["query_id"].to_numpy(), matrix(asked_["query"], d), strict=True):
                near = np.sqrt(((v - x) ** 2).sum(axis=1))
                near[own == q] = np.inf
                t = top(own, near, k, False)
                t = t[np.isfinite(near[t])]
                out[0].append(np.full(len(t), q))
                out[1].append(own[t])
                out[2].append(near[t])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    found = dealt.groupBy("leaf", "part").cogroup(asked.groupBy("leaf", "part")).applyInArrow(score, _FOUND)
    return best(found, k, False)
