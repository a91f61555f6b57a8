"""State of tables, indexes, positions and pools as relations: recovery, merging, throttling, differences of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import batching

#: Heartbeat bounds in seconds, share of a pool in use that is high, seconds of a slow and of an overdue query.
HEARTBEAT_MOST, HEARTBEAT_LEAST = 15.0, 1.0
POOL_HIGH = 0.85
SLOW_S, OVERDUE_S = 30, 300
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys")


def base_tables(catalog: DataFrame) -> DataFrame:
    """Base tables outside of system schemas."""
    return catalog.where((F.col("table_type") == "BASE TABLE") & ~F.lower("schema_name").isin(*SYSTEM_SCHEMAS))


def heartbeat_seconds(wait: Column) -> Column:
    """A third of the server's wait within bounds; where that is no less than the wait, half of it, but not below the bound."""
    third = F.greatest(F.least(wait / 3.0, F.lit(HEARTBEAT_MOST)), F.lit(HEARTBEAT_LEAST))
    return F.when(wait <= 0, HEARTBEAT_MOST).when(third >= wait, F.greatest(wait / 2.0, F.lit(HEARTBEAT_LEAST))).otherwise(third)


def key_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: as 64-bit integers if both are, else as text; null is the empty text."""
    whole = lambda c: F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("long"))
    x, y = whole(a), whole(b)
    s, t = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), sign(x, y)).otherwise(sign(s, t))


def split_key(name: Column) -> tuple[Column, Column]:
    """Schema and table around the first dot; both null where either is empty."""
    at = F.instr(name, ".")
    good = (at > 1) & (at < F.length(name))
    return F.when(good, F.substring_index(name, ".", 1)), F.when(good, F.substr(name, at + 1))


def query_class(seconds: Column) -> Column:
    return F.when(seconds >= OVERDUE_S, "TIMEOUT").when(seconds >= SLOW_S, "SLOW").otherwise("")


def spaced(rows: DataFrame, group: str, order: str, seconds: str, least: int) -> DataFrame:
    """Of each group the first row, and then every next row that is at least `least` seconds after the last one taken."""
    cut = batching.windows(rows, group, order, seconds, least)
    first = cut.groupBy(group, "batch").agg(F.min(F.struct(order, seconds)).alias("f"))
    return first.select(group, f"f.{order}", f"f.{seconds}")


def pool_pressure(samples: DataFrame, group: str, order: str, seconds: str) -> DataFrame:
    """Warnings from samples of a pool (in_use, most, waits so far): waits have grown or the share in use is high; 30 s apart."""
    delta = F.col("waits") - F.lag("waits", 1, 0).over(Window.partitionBy(group).orderBy(order))
    tense = samples.where("most > 0").withColumn("delta", delta).where((F.col("delta") > 0) | (F.col("in_use") / F.col("most") >= POOL_HIGH))
    return spaced(tense, group, order, seconds, 30)


def counter_deltas(snapshots: DataFrame, group: str, order: str, counters: list[str]) -> DataFrame:
    """Growth of each counter since the snapshot before; a counter that fell has begun anew."""
    own = Window.partitionBy(group).orderBy(order)

    def grown(c: str) -> Column:
        before = F.lag(c, 1, 0).over(own)
        return F.when(F.col(c) < before, F.col(c)).otherwise(F.col(c) - before).alias(c)

    return snapshots.select(group, order, *[grown(c) for c in counters])


def merged_indexes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Indexes to restore, by schema, table and name: those of base, and of extra the named ones that base lacks."""
    keys = ["schema_name", "table_name", "index_name"]
    added = extra.where(F.coalesce("index_name", F.lit("")) != "").join(base.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return base.unionByName(added.select(*base.columns))


def index_columns(parts: DataFrame) -> DataFrame:
    """Columns of each index in their order."""
    cols = F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))), lambda p: p["column_name"])
    return parts.where("column_name is not null").groupBy("table_name", "index_name").agg(F.array_join(cols, ",").alias("cols"))


def index_deferred(mode: Column, unique: Column, identity: Column, optimize: Column) -> Column:
    """Mode ALL keeps the identity index, defers other unique ones, and plain ones only if asked; FULL defers if asked."""
    return F.when(identity, False).when((mode == "ALL") & unique, True).otherwise(optimize)


def index_name(line: Column) -> Column:
    """The back-quoted name in a line of table DDL that declares an index; empty in any other line."""
    return F.regexp_extract(F.trim(line), r"^(?:(?:UNIQUE|FULLTEXT|SPATIAL) )?(?:KEY|INDEX) `([^`]+)`", 1)


def final_phase(steps: DataFrame) -> DataFrame:
    """The last phase of each table; one that was published stays so."""
    last = F.max_by("phase", "step")
    return steps.groupBy("table_name").agg(F.when(F.max(F.when(F.col("phase") == "PUBLISHED", 1)) == 1, "PUBLISHED").otherwise(last).alias("phase"), F.max("attempt").alias("attempt"))


def recovery(manifest: DataFrame) -> DataFrame:
    """Tables published and still to do of each task, and whether it is complete: as many as expected, all published."""
    done = F.col("phase") == "PUBLISHED"
    published, n = F.count(F.when(done, 1)), F.count("*")
    return manifest.groupBy("task_id").agg(published.alias("published"), (n - published).alias("pending"), ((published == n) & ((F.max("expected") <= 0) | (n >= F.max("expected")))).alias("complete"))


def appended(existing: DataFrame, new: DataFrame, group: str, order: str) -> DataFrame:
    """New rows with seq counted on from the greatest of their group."""
    top = existing.groupBy(group).agg(F.max("seq").alias("top"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return new.join(top, group, "left").withColumn("seq", F.coalesce("top", F.lit(0)) + n).drop("top")


def kept_secret(incoming: Column, stored: Column, mask: str, blank_too: bool = False) -> Column:
    """A masked value that comes in stands for the stored one; for database passwords of a clone an empty one does too."""
    hidden = incoming == mask
    if blank_too:
        hidden = hidden | (F.coalesce(incoming, F.lit("")) == "")
    return F.when(hidden & stored.isNotNull(), stored).otherwise(incoming)


def insert_text(table: str, columns: list[str], keys: list[str], rows: int, mode: str) -> str:
    """Text of a batch insert with placeholders: plain, upsert (columns outside of the key) or ignore."""
    q = lambda name: "`" + name.replace("`", "``") + "`"
    update = [c for c in columns if c not in keys]
    ignore = mode == "ignore" or mode == "upsert" and not update
    one = "(" + ", ".join("?" * len(columns)) + ")"
    text = f"INSERT {'IGNORE ' if ignore else ''}INTO {q(table)} ({', '.join(map(q, columns))}) VALUES {', '.join([one] * rows)}"
    return text + (" ON DUPLICATE KEY UPDATE " + ", ".join(f"{q(c)} = VALUES({q(c)})" for c in update) if mode == "upsert" and update else "")
