"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two grouped minima and two equi-joins, so a node with very many edges is pre-aggregated and its join side
can be split. Each round's edges are written to the shared folder; nothing is gathered on the driver but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has an edge and is not the smallest of its component, with that smallest node.

    edges: (u long, v long), any order, repeats and loops allowed; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now, path = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    while before[0]:
        after, new = staged(_small_star(_large_star(now)))
        state = _state(after)
        drop_stage(spark, path)
        now, path = after, new
        if state == before:
            break
        before = state
    return now
