"""Row-count reconciliation, progress and attempt state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """table_name and its exact number of rows, one scan of each that reads no column."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table_name"), name) for t, df in tables.items()])


def detail(source: DataFrame, target: DataFrame) -> DataFrame:
    """A row a table: counts of both sides, difference (target - source), matched; a side that failed is null."""
    both = source.join(target, "table_name", "full_outer")
    return both.select("table_name", "source_rows", "target_rows", (F.col("target_rows") - F.col("source_rows")).alias("difference"), (F.col("target_rows") == F.col("source_rows")).alias("matched"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals over tables with both sides, and totals over every side that is there; they differ when a side failed."""
    ok = F.col("source_rows").isNotNull() & F.col("target_rows").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("checked"), n(ok & (F.col("source_rows") == F.col("target_rows"))).alias("matched"), n(ok & (F.col("source_rows") != F.col("target_rows"))).alias("mismatched"), n(~ok).alias("failed"),
        total(F.when(ok, F.col("source_rows"))).alias("source_total"), total(F.when(ok, F.col("target_rows"))).alias("target_total"),
        total("source_rows").alias("source_available"), total("target_rows").alias("target_available"),
    )


def status(totals: DataFrame) -> DataFrame:
    good = F.col("matched") + F.col("mismatched")
    return totals.withColumn("status", F.when(good == 0, "FAILED").when(F.col("failed") > 0, "PARTIAL").when(F.col("mismatched") > 0, "MISMATCHED").otherwise("MATCHED"))


def progress(processed: Column, total: Column, elapsed: Column, capped: bool) -> tuple[Column, Column, Column]:
    """Per cent (of a table at most 100, of a task as it is), rows a second, seconds left (-1 if unknown)."""
    share = F.when(total > 0, processed * 100.0 / total).otherwise(0.0)
    speed = F.when(elapsed > 0, processed * 1.0 / elapsed).otherwise(0.0)
    left = F.when((speed > 0) & (total > processed), (total - processed) / speed).when((total > 0) & (processed >= total), 0.0).otherwise(-1.0)
    return (F.least(share, F.lit(100.0)) if capped else share), speed, left
