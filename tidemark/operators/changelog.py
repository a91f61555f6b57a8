"""Change events: positions, transactions, normalisation, filters by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_number(file: Column) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({file}, '([0-9]+)$', 1), '') as bigint)") if isinstance(file, str) else F.nullif(F.regexp_extract(file, "([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def position(file: Column, pos: Column) -> Column:
    """Orders by numeric file suffix (files without one first), then by name, then by offset."""
    return F.struct(file_number(file).alias("seq"), file.alias("file"), pos.alias("pos"))


def parse_position(text: Column) -> Column:
    """file and pos of file:pos, split at the last colon; null unless the file has a name and pos is 4 or more."""
    file, pos = F.regexp_extract(text, "^(.+):([0-9]+)$", 1), F.regexp_extract(text, "^(.+):([0-9]+)$", 2)
    return F.when((file != "") & (F.nullif(pos, F.lit("")).try_cast("bigint") >= 4), F.struct(file.alias("file"), pos.try_cast("bigint").alias("pos")))


def normalised(log: DataFrame, task_id: str, schema: str, table_name: str) -> DataFrame:
    """One event a row: keys from the before image of a DELETE, else from the after image; absent images null."""
    image = lambda key: F.struct(F.col(key).alias("user_id"), "event_type", "value")
    after = F.when(F.col("op") != "DELETE", image("new_key"))
    before = F.when(F.col("op") != "INSERT", image("old_key"))
    key = F.when(F.col("op") == "DELETE", F.col("old_key")).otherwise(F.col("new_key"))
    row = F.row_number().over(Window.partitionBy("txn").orderBy("event_id")) - 1
    trace = lambda n: F.concat_ws(":", F.lit(task_id), "file", F.col("commit_pos").cast("string"), n.cast("string"))
    return log.select("event_id", F.lit(task_id).alias("task_id"), F.lit(schema).alias("source_schema"), F.lit(table_name).alias("source_table"), F.col("op").alias("event_type"), F.col("file").alias("binlog_file"), F.col("commit_pos").alias("binlog_pos"), key.alias("key"), before.alias("before"), after.alias("after"), trace(F.lit(0)).alias("trace_id"), trace(row).alias("event_uid"))


def exploded(batched: DataFrame) -> DataFrame:
    """Row events with arrays of images to rows: an UPDATE's images alternate before and after; DELETE holds before images. An
    event without rows is an error."""
    pairs = F.expr("transform(sequence(0, size(images) div 2 - 1), i -> struct(i as n, images[2 * i] as before, images[2 * i + 1] as after))")
    single = F.expr("transform(images, (x, i) -> struct(i as n, if(op = 'DELETE', x, cast(null as bigint)) as before, if(op = 'INSERT', x, cast(null as bigint)) as after))")
    some = F.when(F.coalesce(F.size("images"), F.lit(0)) > 0, True).otherwise(F.raise_error(F.concat(F.col("op"), F.lit(" event without rows"))).cast("boolean"))
    rows = batched.where(some).withColumn("r", F.explode(F.when(F.col("op") == "UPDATE", pairs).otherwise(single)))
    return rows.select("txn", "op", F.col("r.n").cast("long").alias("row_index"), "r.before", "r.after")


def bounded(log: DataFrame, after: tuple[str, int], until: tuple[str, int]) -> DataFrame:
    """Whole transactions of (after, until]: up to and with the first whose commit position reaches until."""
    at = position(F.col("file"), F.col("commit_pos"))
    low = position(F.lit(after[0]), F.lit(after[1]).cast("long"))
    high = position(F.lit(until[0]), F.lit(until[1]).cast("long"))
    past = log.where(at > low)
    stop = past.where(at >= high).agg(F.min(at).alias("stop"))  # one row
    return past.join(F.broadcast(stop)).where(F.col("stop").isNull() | (at <= F.col("stop"))).drop("stop")


def unapplied(log: DataFrame, marks: DataFrame) -> DataFrame:
    """For each sink the events past its stored position; a sink without one gets all. marks: a row a sink."""
    at, stored = position(F.col("file"), F.col("commit_pos")), position(F.col("mark_file"), F.col("mark_pos"))
    return log.join(F.broadcast(marks)).where(F.col("mark_file").isNull() | (at > stored))


def lag_bytes(current_file: Column, current: Column, master_file: Column, master: Column) -> Column:
    """Bytes behind within one file, at least 0; the greatest unsigned long across files."""
    return F.when(current_file == master_file, F.greatest(master - current, F.lit(0))).otherwise(F.lit("18446744073709551615").cast("decimal(20,0)")).cast("decimal(20,0)")


def server_id(name: Column) -> Column:
    """h = h * 31 + code point, unsigned 32 bits; 0 becomes 1."""
    h = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)
    return F.when(h == 0, 1).otherwise(h).cast("bigint")


def checkpoints(log: DataFrame, writes: Column) -> DataFrame:
    """A row a transaction: its commit position, which is saved whether it writes or not, the rows it writes, and whether its
    sink transaction is dropped because there are none."""
    rows = F.count(F.when(writes, 1))
    return log.groupBy("txn").agg(F.max("file").alias("file"), F.max("commit_pos").alias("pos"), rows.alias("n_writes"), (rows == 0).alias("aborted"))


def wire(event: DataFrame) -> Column:
    """The JSON document of a change event, fields in their fixed order: task_id, source_schema, source_table, event_type, event_time,
    binlog_file, binlog_pos, primary_keys, before and after (left out where absent), trace_id (left out where empty).
    primary_keys, before and after are structs, written with fields in name order and nulls; <, > and & are escaped."""
    image = lambda c: F.to_json(F.struct(*[F.col(f"{c}.{f}") for f in sorted(event.schema[c].dataType.names)]), {"ignoreNullFields": "false"})

    def text(c: str) -> Column:
        """The value as a JSON string: a document of one field without what stands around its value."""
        document = F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x")))
        return F.substr(document, F.lit(6), F.length(document) - 6)

    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    parts = [part(c, text(c)) for c in ("task_id", "source_schema", "source_table", "event_type")]
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    parts += [part("event_time", F.concat(F.lit('"'), stamp, F.lit('Z"'))), part("binlog_file", text("binlog_file")), part("binlog_pos", F.col("binlog_pos").cast("string")), part("primary_keys", image("primary_keys"))]
    parts += [F.when(F.col(c).isNotNull(), part(c, image(c))) for c in ("before", "after")]
    parts += [F.when(F.col("trace_id") != "", part("trace_id", text("trace_id")))]
    out = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))
    for sign in "<>&":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out


def message_topic(mode: str, topic: str, prefix: str) -> Column:
    return F.concat_ws(".", F.lit(prefix), "source_schema", "source_table") if mode == "per_table" else F.lit(topic)


def message_key(event: DataFrame, mode: str) -> Column:
    """The key values joined by colons, columns in name order; schema.table:position without keys or in mode none."""
    names = sorted(event.schema["primary_keys"].dataType.names)
    if mode == "none" or not names:
        return F.concat(F.col("source_schema"), F.lit("."), F.col("source_table"), F.lit(":"), F.col("binlog_pos").cast("string"))
    return F.array_join(F.array(*[F.coalesce(F.col(f"primary_keys.{n}").cast("string"), F.lit("<nil>")) for n in names]), ":")
