"""Vector tables as matrices, and merging of partial top-k rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str, zero: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, vec), number of rows, dimension: without null ids, null vectors, vectors with null or non-finite components
    or of a length other than the most frequent one, and, unless zero, without zero vectors."""
    vec = F.col(column)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0").where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows, 0, 0
    return rows.where(F.size("vec") == sizes[0]["d"]), sizes[0]["count"], sizes[0]["d"]


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """A fixed pseudo-random choice of about min(n, most) rows, most at the limit."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(most)


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query with their rank; ties to the smaller vec_id."""
    score = F.desc("score") if descending else F.asc("score")
    own = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int, descending: bool) -> np.ndarray:
    """Indices of the k best, best first, ties to the smaller id."""
    key = -scores if descending else scores
    if len(key) > 4 * k:
        near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
        return near[np.lexsort((ids[near], key[near]))][:k]
    return np.lexsort((ids, key))[:k]
