"""Readers of a table by how its rows are identified."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import keyset


def unordered_stream(df: DataFrame) -> DataFrame:
    """All rows in no order: of a table without a key."""
    return df


def range_stream(df: DataFrame, key: list[str], start: list | None = None, end: list | None = None) -> DataFrame:
    """All rows of (start, end] in key order, without a limit."""
    if start is not None:
        df = df.where(keyset.after(key, start))
    if end is not None:
        df = df.where(keyset.up_to(key, end))
    return df.orderBy(*key)


def open_reader(df: DataFrame, strategy: str, key: list[str], start: list | None = None, end: list | None = None, limit: int | None = None) -> DataFrame:
    """A table identified by all its columns is one unordered stream; any other is read by key, a page where a limit is given."""
    if strategy == "FULL_COLUMNS_STRATEGY":
        return unordered_stream(df)
    return range_stream(df, key, start, end) if limit is None else keyset.page(df, key, start, end, limit)
