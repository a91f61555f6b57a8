"""Queries over the task event log: filters, grouping, retention, aggregation of repeats, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import batching

#: Ranks of severities.
SEVERITIES = (("INFO", 0), ("WARN", 1), ("ERROR", 2))


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITIES:
        out = F.when(severity == name, rank).otherwise(out)
    return out


def listed(events: DataFrame, task_id: str, before: int | None = None, after: int | None = None, least: str | None = None, limit: int = 100, **equal: str) -> DataFrame:
    """The newest events of a task, by seq; limit 0 or less is 100, more than 500 is 500. equal: values that columns must have
    (execution_id, visibility, category, code, source_schema, source_table); an empty one asks for nothing."""
    rows = events.where(F.col("task_id") == task_id)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value else rows
    if before is not None:
        rows = rows.where(F.col("seq") < before)
    if after is not None:
        rows = rows.where(F.col("seq") > after)
    if least is not None:
        rows = rows.where(severity_rank(F.col("severity")) >= dict(SEVERITIES).get(least, -1))
    return rows.orderBy(F.desc("seq")).limit(min(limit, 500) if limit > 0 else 100)


def executions(events: DataFrame) -> DataFrame:
    return events.groupBy("task_id", "execution_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("events"))


def kept(events: DataFrame, most_key: int, most_errors: int, oldest, protected: DataFrame) -> DataFrame:
    """What retention keeps of each task: all of protected executions; of the others, without KEY events older than `oldest`, the
    newest most_key KEY events and the newest most_errors errors. An error that is a KEY event counts in both.
    Numbers of 0 or less are 2000 and 200."""
    guarded = events.join(protected.select("task_id", "execution_id").distinct().withColumn("guard", F.lit(True)), ["task_id", "execution_id"], "left")
    key, error, guard = F.col("visibility") == "KEY", F.col("severity") == "ERROR", F.coalesce("guard", F.lit(False))
    left = ~guard & ~(key & (F.col("ts") < oldest))
    newest = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    nth = lambda kind: F.sum(F.when(left & kind, 1).otherwise(0)).over(newest)
    ranked = guarded.withColumns({"n_key": nth(key), "n_error": nth(error)})
    few_keys, few_errors = F.col("n_key") <= (most_key if most_key > 0 else 2000), F.col("n_error") <= (most_errors if most_errors > 0 else 200)
    return ranked.where(guard | left & (key & few_keys | error & few_errors)).select(*events.columns)


def removed(events: DataFrame, keep: DataFrame) -> DataFrame:
    return events.join(keep.select("task_id", "seq"), ["task_id", "seq"], "left_anti").select(*events.columns)


def fingerprint(*columns: str) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of the values joined by a bar."""
    return F.substring(F.sha2(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), "|").cast("binary"), 256), 1, 32)


def windows_from_first(events: DataFrame, group: str, order: str, seconds: str, length: int) -> DataFrame:
    """Repeats gathered in windows of `length` seconds, each begun by the first event after the window before: group, window,
    first_s, last_s, n."""
    return batching.windows(events, group, order, seconds, length).groupBy(group, F.col("batch").alias("window")).agg(F.min(seconds).alias("first_s"), F.max(seconds).alias("last_s"), F.count("*").alias("n"))


def edges(levels: DataFrame, group: str, order: str, level: str, high: float, low: float) -> DataFrame:
    """Rows where a level rises to high (HIGH) or, after that, falls below low (RECOVERED). Between the two nothing changes, so
    the state is the last level outside of them."""
    side = F.when(F.col(level) >= high, "HIGH").when(F.col(level) < low, "RECOVERED")
    marked = levels.withColumn("side", side).where("side is not null")
    last = F.lag("side", 1, "RECOVERED").over(Window.partitionBy(group).orderBy(order))
    return marked.withColumn("last", last).where("side <> last").drop("last")


def stalls(progress: DataFrame, group: str, order: str, seconds: str, rows: str, threshold: int) -> DataFrame:
    """NO_PROGRESS once when rows have not grown for threshold seconds, RECOVERED when they grow again."""
    own = Window.partitionBy(group).orderBy(order)
    grew = progress.withColumn("grew", F.coalesce(F.col(rows) > F.lag(rows).over(own), F.lit(True)))
    since = grew.withColumn("since", F.last(F.when(F.col("grew"), F.col(seconds)), ignorenulls=True).over(own))
    state = since.withColumn("stalled", F.col(seconds) - F.col("since") >= threshold)
    was = F.coalesce(F.lag("stalled").over(own), F.lit(False))
    return state.withColumn("was", was).where("stalled <> was").withColumn("event", F.when(F.col("stalled"), "NO_PROGRESS").otherwise("RECOVERED")).select(group, order, "event")
