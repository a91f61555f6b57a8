"""Metrics: measures (name, kind, ord, value) to samples (sample, value), by one aggregation with partial sums.

counter: the sum of what was added; gauge: the value last set (greatest ord); histogram: counts of values up to each bound, all
below "+Inf", their sum and their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets in seconds.
BOUNDS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10")


def samples(measures: DataFrame, bounds: tuple[str, ...] = BOUNDS) -> DataFrame:
    """value is decimal or integer, so that sums do not depend on the order of rows."""
    value = F.col("value")
    under = [F.count(F.when(value <= F.lit(b).cast("double"), 1)).alias(f"under_{k}") for k, b in enumerate(bounds)]
    all_ = measures.groupBy("name", "kind").agg(F.sum("value").cast("double").alias("total"), F.max_by("value", "ord").cast("double").alias("last"), F.count("value").alias("n"), *under)

    def sample(suffix: str, v: Column) -> Column:
        return F.struct(F.concat(F.col("name"), F.lit(suffix)).alias("sample"), v.cast("double").alias("value"))

    buckets = [sample(f'_bucket{{le="{b}"}}', F.col(f"under_{k}")) for k, b in enumerate(bounds)]
    histogram = F.array(*buckets, sample('_bucket{le="+Inf"}', F.col("n")), sample("_sum", F.col("total")), sample("_count", F.col("n")))
    one = F.array(sample("", F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total"))))
    return all_.select(F.explode(F.when(F.col("kind") == "histogram", histogram).otherwise(one)).alias("s")).select("s.*")


def exposition(samples_: DataFrame, prefix: str = "") -> DataFrame:
    """Samples as lines of the text format that scrapers read."""
    return samples_.select(F.concat(F.lit(prefix), F.col("sample"), F.lit(" "), F.col("value").cast("string")).alias("line"))
