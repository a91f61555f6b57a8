"""Replay of a change log over a base table.

Keyed tables: an INSERT puts or overwrites a row, an UPDATE changes a row that is there (it never makes one), a DELETE
removes it, a change of key is a DELETE and an INSERT. The closed form of folding these in order: a key is present if its last
anchor (INSERT, DELETE or base row) is not a DELETE, with the image of its last operation other than DELETE. One
aggregation by key, with partial aggregation before the shuffle, so a key with very many changes is a few rows of it.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def operations(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """key, ord, sub, op, value: key changes in two; base (key, value) as INSERTs before the log."""
    moved = (F.col("op") == "UPDATE") & (F.col("old_key") != F.col("new_key"))
    two = F.array(F.struct(F.col("old_key").alias("key"), F.lit(0).alias("sub"), F.lit("DELETE").alias("op")), F.struct(F.col("new_key").alias("key"), F.lit(1).alias("sub"), F.lit("INSERT").alias("op")))
    one = F.array(F.struct(F.col("old_key").alias("key"), F.lit(0).alias("sub"), F.col("op").alias("op")))
    out = log.select("event_id", "value", F.explode(F.when(moved, two).otherwise(one)).alias("x")).select("x.key", F.col("event_id").alias("ord"), "x.sub", "x.op", "value")
    if base is not None:
        out = out.unionByName(base.select("key", F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("sub"), F.lit("INSERT").alias("op"), "value"))
    return out


def keyed(ops: DataFrame) -> DataFrame:
    """key, value of the rows present after the last operation."""
    at = F.struct("ord", "sub")
    anchor = F.max(F.when(F.col("op") != "UPDATE", F.struct("ord", "sub", "op")))
    image = F.max_by("value", F.when(F.col("op") != "DELETE", at))
    return ops.groupBy("key").agg(anchor.alias("a"), image.alias("value")).where("a.op = 'INSERT'").select("key", "value")


def unmatched(ops: DataFrame) -> DataFrame:
    """UPDATEs and DELETEs that found no row: before them stood no anchor, or a DELETE."""
    before = Window.partitionBy("key").orderBy("ord", "sub").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "UPDATE", F.col("op")), ignorenulls=True).over(before)
    return ops.withColumn("last", last).where("op <> 'INSERT' and (last is null or last = 'DELETE')").drop("last")


def latest_fields(log: DataFrame, key: str, fields: list[str], present: str = "present", order: str = "event_id") -> DataFrame:
    """Partial images: each field's last value among the images that have it; a null that an image has is a value. present: the
    names of the fields of an image."""
    return log.groupBy(key).agg(*[F.max_by(f, F.when(F.array_contains(present, f), F.col(order))).alias(f) for f in fields])


def matches(image: dict[str, Column]) -> Column:
    """Whether a row's columns equal the image's values; a null on either side matches nothing."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in image.items()])


def bag(log: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Multiplicity of each tuple of a table without a key after INSERTs and DELETEs of one row at most:
    S_n - min(0, min S_k). log: columns, ord, op; base: columns, n."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])  # a comparison with null matches no row
    log = log.where((F.col("op") == "INSERT") | whole)
    step = log.select(*columns, "ord", F.when(F.col("op") == "INSERT", 1).otherwise(-1).alias("d")).unionByName(base.select(*columns, F.lit(-1).cast("long").alias("ord"), F.col("n").cast("int").alias("d")))
    running = F.sum("d").over(Window.partitionBy(*columns).orderBy("ord"))
    return step.withColumn("s", running).groupBy(*columns).agg((F.max_by("s", "ord") - F.least(F.lit(0), F.min("s"))).cast("long").alias("n")).where("n > 0")


def bag_folded(log: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """The same with UPDATEs (old_<column>: the image before): one row at most that equals the image before becomes the image
    after; without such a row nothing happens. An UPDATE couples two tuples, so this is an ordered fold: the log streams
    through one task, which holds the multiplicities of the distinct tuples of one table."""
    old = [f"old_{c}" for c in columns]
    types = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    start = base.select(*columns, *[F.lit(None).cast(types[c]).alias(c) for c in old], F.lit("BASE").alias("op"), F.lit(None).cast("long").alias("ord"), F.col("n").cast("long").alias("n"))
    steps = log.select(*columns, *old, "op", F.col("ord").cast("long").alias("ord"), F.lit(1).cast("long").alias("n")).unionByName(start)

    def fold(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new, before, op = tuple(row[c] for c in columns), tuple(row[c] for c in old), row["op"]
                gone = new if op == "DELETE" else before if op == "UPDATE" else None
                if gone is not None:
                    if None in gone or not held.get(gone):
                        continue
                    held[gone] -= 1
                if op != "DELETE":
                    held[new] = held.get(new, 0) + row["n"]
        rows = [{**dict(zip(columns, k, strict=True)), "n": n} for k, n in held.items() if n > 0]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema)

    out = log.select(*columns).withColumn("n", F.lit(0).cast("long")).schema
    schema = to_arrow_schema(out)
    return steps.repartition(1).sortWithinPartitions(F.col("ord").asc_nulls_first()).mapInArrow(fold, out)


def upserted(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """target with the rows of batch put in: the last of a key (greatest ord) wins."""
    last = batch.groupBy(key).agg(*[F.max_by(c, "ord").alias(c) for c in target.columns if c != key])
    return target.join(last, key, "left_anti").unionByName(last.select(*target.columns))


def ignored(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """target with the rows of batch whose key is new: the first of a key (least ord) stays."""
    first = batch.groupBy(key).agg(*[F.min_by(c, "ord").alias(c) for c in target.columns if c != key])
    return target.unionByName(first.join(target, key, "left_anti").select(*target.columns))


def drift(source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, extra or different (an extension: the counts of the reconciliation, key by key)."""
    s = source.select(key, F.col(value).alias("source_value"), F.lit(True).alias("in_source"))
    t = target.select(key, F.col(value).alias("target_value"), F.lit(True).alias("in_target"))
    both = s.join(t, key, "full_outer")
    kind = F.when(F.col("in_target").isNull(), "missing").when(F.col("in_source").isNull(), "extra").when(~F.col("source_value").eqNullSafe(F.col("target_value")), "different")
    return both.withColumn("kind", kind).where("kind is not null").drop("in_source", "in_target")
