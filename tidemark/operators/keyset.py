"""Keyset predicates and pages. A tuple comparison is an OR-tree of column comparisons, which reaches the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _branch(columns, values, k: int, last: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns[:k], values[:k], strict=True)] + [last])


def after(columns: list[str], values: list) -> Column:
    """(columns) > (values)."""
    return reduce(lambda a, b: a | b, [_branch(columns, values, k, F.col(columns[k]) > values[k]) for k in reversed(range(len(columns)))])


def up_to(columns: list[str], values: list) -> Column:
    """(columns) <= (values): strict branches, the last one inclusive."""
    n = len(columns)
    return reduce(lambda a, b: a | b, [_branch(columns, values, k, F.col(columns[k]) <= values[k] if k == n - 1 else F.col(columns[k]) < values[k]) for k in range(n)])


def up_to_by_equality(columns: list[str], values: list) -> Column:
    """The same bound as an equality branch and strict branches."""
    strict = [_branch(columns, values, k, F.col(columns[k]) < values[k]) for k in range(len(columns))]
    equal = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, values, strict=True)])
    return reduce(lambda a, b: a | b, strict, equal)


def page(df: DataFrame, columns: list[str], start: list | None = None, end: list | None = None, limit: int = 1000) -> DataFrame:
    """The next rows of the interval (start, end] in key order; an open end is None, a limit of 0 or less is 1000."""
    if start is not None:
        df = df.where(after(columns, start))
    if end is not None:
        df = df.where(up_to(columns, end))
    return df.orderBy(*columns).limit(limit if limit > 0 else 1000)


def writable(df: DataFrame, generated: set[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in generated])


def payload_of_keys(df: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """Two-phase read: rows of the probed keys. A key that has vanished is left out; the others are not lost with it."""
    return df.join(probe.select(key), key, "left_semi")
