"""Chunk plans: intervals (start, end] whose first start and last end are open, and rows to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a search: arrays of up to 2^20 - 1 values.
SEARCH_BITS = 20
#: Bytes of a key range that one task sorts, and how many values of a sample are taken for each range.
RANGE_BYTES, SAMPLED = 128 << 20, 100


def count_below(bounds: Column, value: Column, bits: int = SEARCH_BITS) -> Column:
    """How many values of the sorted array, of less than 2^bits values, are less than value, by halving; 0 for null."""
    at = lambda k: F.get(bounds, k)
    steps = [F.lit(1 << k) for k in range(bits - 1, -1, -1)]
    return F.aggregate(F.array(*steps), F.lit(0), lambda pos, step: F.when(at(pos + step - 1) < value, pos + step).otherwise(pos))


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _range_bounds(df: DataFrame, names: list[str], buckets: int) -> tuple[Column, int] | None:
    """At most buckets - 1 tuples, and the bits of their number, that cut the table into ranges of about equal size, from a sample
    of bounded size. Which ones they are only matters for speed."""
    sample = df.select(*names).dropna().orderBy(F.rand(7)).limit(SAMPLED * buckets)
    row = sample.agg(F.array_sort(F.collect_set(F.struct(*names))).alias("x")).first()
    picked = row["x"][:: max(1, -(-len(row["x"]) // buckets))][1:]
    types = {f.name: f.dataType for f in df.select(*names).schema.fields}
    tuples = [F.struct(*[F.lit(v[n]).cast(types[n]).alias(n) for n in names]) for v in picked]
    return (F.array(*tuples), len(tuples).bit_length()) if tuples else None


def numbered(df: DataFrame, key: str | list[str], buckets: int | None = None) -> DataFrame:
    """df with rn, the place of each row in key order from 1 (nulls first; rows of one key in any order), without one task that
    sees every row: key ranges, one for every 128 MB, are numbered on their own and begin where the ranges before them end."""
    names = _names(key)
    if buckets is None:
        size = df.select(*names)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        buckets = min(max(int(str(size)) // RANGE_BYTES, 8), 4096)
    bounds = _range_bounds(df, names, buckets)
    dealt = df.withColumn("__bucket", count_below(bounds[0], F.struct(*names), bounds[1]) if bounds is not None else F.lit(0))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    base = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__bucket").orderBy(*names)
    return dealt.withColumn("rn", F.row_number().over(own)).join(F.broadcast(base), "__bucket").withColumn("rn", F.col("rn") + F.col("__base")).drop("__bucket", "__base")


def extent(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).cast("long").alias("min_key"), F.max(key).cast("long").alias("max_key"), F.coalesce(F.min(key), F.lit(0)).cast("long").alias("min_or_0"), F.coalesce(F.max(key), F.lit(-1)).cast("long").alias("max_or_minus_1"))


def int_range(df: DataFrame, key: str, target: int) -> DataFrame:
    """n = min(target, span) intervals; end i = min + floor(span * (i + 1) / n) - 1, in decimals so that the whole long range fits."""
    span = (F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    plan = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo is not null").withColumn("span", span)
    plan = plan.withColumn("n", F.least(F.lit(target).cast("decimal(20,0)"), F.col("span")).cast("long")).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    # span * (i + 1) / n = q * (i + 1) + rest * (i + 1) / n with span = q * n + rest: neither part leaves its type.
    plan = plan.withColumn("q", F.expr("cast(floor(span / cast(n as decimal(10,0))) as decimal(21,0))")).withColumn("rest", F.expr("cast(span - q * cast(n as decimal(10,0)) as bigint)"))
    plan = plan.withColumn("end", F.expr("if(i < n - 1, cast(cast(lo as decimal(21,0)) + q * cast(i + 1 as decimal(10,0)) + cast((rest * (i + 1)) div n as decimal(20,0)) - 1 as bigint), cast(null as bigint))"))
    own = Window.orderBy("i")
    return plan.select(F.col("i").alias("chunk_id"), F.lag("end").over(own).alias("start_key"), F.col("end").alias("end_key"))


def equal_split(df: DataFrame, key: str, n: int) -> DataFrame:
    """Intervals of ceil(span / n) keys from the least key on; ends open."""
    plan = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo is not null").withColumn("step", F.ceil((F.col("hi") - F.col("lo") + 1) / n)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return plan.select(F.col("i").cast("long").alias("chunk_id"), F.when(F.col("i") > 0, F.col("lo") + F.col("i") * F.col("step")).cast("long").alias("start_key"), F.when(F.col("i") < n - 1, F.col("lo") + (F.col("i") + 1) * F.col("step")).cast("long").alias("end_key"))


def nth_row(df: DataFrame, key: str | list[str], step: int, most: int) -> DataFrame:
    """Every step-th key in order, at most `most` of them: as column key, or as its columns if it has several."""
    names = _names(key)
    marks = numbered(df.select(*names), names).where((F.col("rn") % step == 0) & (F.col("rn") <= step * most))
    shown = [F.col(names[0]).alias("key")] if len(names) == 1 else names
    return marks.select((F.col("rn") / step).cast("long").alias("boundary"), *shown)


def legacy_steps(df: DataFrame, key: str, step: int, n: int) -> DataFrame:
    """n - 1 boundaries of step keys each; a short page ends them; a boundary not above the last by text order is dropped."""
    marks = numbered(df.select(key), key).where((F.col("rn") % step == 0) & (F.col("rn") <= step * (n - 1))).withColumn("text", F.col(key).cast("string"))
    top = F.max("text").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))  # at most n - 1 rows
    return marks.withColumn("top", top).where("top is null or text > top").select(F.col(key).alias("key"), "text")


def strategy(df: DataFrame, key: str, estimated_rows: int) -> DataFrame:
    """Ranges, or pages where the key span is more than four times the rows."""
    span = F.max(key) - F.min(key) + 1
    return df.agg(span.cast("long").alias("span")).withColumn("estimated_rows", F.lit(estimated_rows).cast("long")).withColumn("plan", F.when(F.col("span").isNull(), "single").when(F.col("span") > 4 * F.col("estimated_rows"), "keyset").otherwise("range"))


def assigned(df: DataFrame, key: str, plan: DataFrame) -> DataFrame:
    """df with the chunk that its key falls into (a null key: the first), found by halving in the plan, which is one row of as
    many intervals as chunks were asked for: they follow each other without gaps, and the last has no end."""
    last = F.col("end_key").isNull()
    one = plan.agg(F.array_sort(F.collect_list(F.struct(last.alias("last"), "end_key", "chunk_id", "start_key"))).alias("__plan"))
    ends = F.transform(F.filter("__plan", lambda p: ~p["last"]), lambda p: p["end_key"])
    found = df.join(F.broadcast(one)).withColumn("__chunk", F.get("__plan", count_below(ends, F.col(key)))).where("__chunk is not null")
    return found.select(*df.columns, "__chunk.chunk_id", "__chunk.start_key", "__chunk.end_key")


def fair_order(plan: DataFrame) -> DataFrame:
    """Chunks in the order in which a round robin over tables takes them."""
    turn = F.row_number().over(Window.partitionBy("table_name").orderBy("chunk_id"))
    return plan.withColumn("turn", turn.cast("long")).select("table_name", "chunk_id", "turn")
