"""Ordered folds that cut rows into batches, statements and transactions.

Groups are independent; rows of a group stream through one task in order, with a few numbers of state, so a group may be
larger than memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package


def _fold(df: DataFrame, group: str, order: str, size: str, cut: Callable[[int, int, int, int], bool]) -> DataFrame:
    """df (group, order, size) with the batch number of each row; cut(rows, bytes, first size, next size): begin anew before this row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, rows, held, first = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for g, s in zip(batch[group], batch[size], strict=True):
                if g != now:
                    now, number, rows, held = g, 0, 0, 0
                elif cut(rows, held, first, s):
                    number, rows, held = number + 1, 0, 0
                first = first if rows else s
                rows, held = rows + 1, held + s
                out.append(number)
            yield batch.assign(batch=out)

    rows = df.select(group, order, size).repartition(group).sortWithinPartitions(group, order)
    return rows.mapInPandas(run, f"{group} string, {order} long, {size} long, batch long")


def reader_batches(df: DataFrame, group: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The row that reaches the byte limit is still of its batch."""
    return _fold(df, group, order, size, lambda rows, held, first, s: rows >= most_rows or held >= most_bytes)


def writer_statements(df: DataFrame, group: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The row that would exceed the byte limit begins the next statement."""
    return _fold(df, group, order, size, lambda rows, held, first, s: rows >= most_rows or held + s > most_bytes)


def windows(df: DataFrame, group: str, order: str, seconds: str, length: int) -> DataFrame:
    """A window begins with its first row and takes all within length seconds of it."""
    return _fold(df, group, order, seconds, lambda rows, held, first, s: s >= first + length)


def buffered(rows: DataFrame, group: str, order: str, seconds: str, most: int, every: int) -> DataFrame:
    """rows with the flush (tick, part) of a buffer that is written once it holds `most` rows and whenever a timer ticks, every
    `every` seconds: nothing outlives a tick, so a tick's rows are numbered on their own."""
    tick = F.floor(F.col(seconds) / every).cast("long")
    n = F.row_number().over(Window.partitionBy(group, "tick").orderBy(order))
    return rows.withColumn("tick", tick).withColumn("part", F.floor((n - 1) / most).cast("long"))
