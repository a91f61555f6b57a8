"""Rules by which a load's parts work together: which error a run reports, when a table is ready, what becomes of a write whose
outcome is unknown, pool sizes, full queues, and what task verbs allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import first_broken

#: Connections where none are set, the fewest idle ones, seconds that a connection lives.
OPEN, IDLE, LIFETIME = 32, 16, 180


def reported_error(writer: Column, reader: Column, parent: Column, own: Column, cancelled: Column, stop: Column) -> Column:
    """The error of a run: the writer's, then the reader's, unless it is a cancellation; then the cause that the parent was ended
    for, then the run's own; then cancellations, the writer's first. If that is a plain cancellation, a named cause to stop
    replaces it. cancelled: the array of texts that are cancellations; null is no error."""
    plain = lambda e: F.array_contains(cancelled, e)
    real = lambda e: F.when(~plain(e), e)
    chosen = F.coalesce(real(writer), real(reader), parent, own, writer, reader)
    return F.when(plain(chosen), F.coalesce(stop, chosen)).otherwise(chosen)


def timeout_text(c: str = "") -> Column:
    """Message of a read that took too long, over columns elapsed, timeout, schema_name, table_name, chunk, phase, cursor_text,
    start_text, end_text (blank or null: not named), each after the prefix c."""
    named = [F.when(F.col(c + column) != "", F.concat(F.lit(f" {name}="), F.col(c + column))) for name, column in (("chunk", "chunk"), ("phase", "phase"), ("cursor", "cursor_text"), ("start", "start_text"), ("end", "end_text"))]
    head = F.format_string("source query timeout after %s (limit %s): table=%s.%s", c + "elapsed", c + "timeout", c + "schema_name", c + "table_name")
    return F.concat(head, *[F.coalesce(n, F.lit("")) for n in named])


def ready_at(steps: DataFrame, group: str, order: str, kind: str, n: str) -> DataFrame:
    """Of steps enqueued (one batch), committed (n batches), aborted (one batch) and read_done, the first at which reading has
    ended and nothing is under way: group, ready (null: never). The number under way never falls below zero, so it is the
    running sum less its least value so far. Groups are independent; the state is a few running numbers."""
    kind_ = F.col(kind)
    taken = F.when(kind_ == "enqueued", 1).when(kind_ == "aborted", -1).when((kind_ == "committed") & (F.col(n) > 0), -F.col(n)).otherwise(0).cast("long")
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max((kind_ == "read_done").cast("int")).over(so_far) == 1
    summed = steps.withColumn("__sum", F.sum(taken).over(so_far)).withColumn("__ended", ended)
    left = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(so_far))
    asked = (kind_ != "enqueued") & ~((kind_ == "committed") & (F.col(n) <= 0))
    marked = summed.withColumn("__ready", F.col("__ended") & (left == 0) & asked)
    return marked.groupBy(group).agg(F.min(F.when(F.col("__ready"), F.col(order))).alias("ready"))


def write_outcome(writes: DataFrame, markers: DataFrame, most: int) -> DataFrame:
    """Over writes (marker, committed, error_class: '' or retryable or fatal, recoveries) and the markers found in the target:
    writes with outcome done, replay (its commit failed for the connection and its marker is not there), exhausted (the same after
    `most` recoveries, when the target is not asked any more), failed, or refused (no marker)."""
    found = writes.join(markers.select("marker").distinct().withColumn("__found", F.lit(True)), "marker", "left")
    outcome = (
        F.when(F.coalesce("marker", F.lit("")) == "", "refused").when(F.col("committed"), "done").when(F.col("error_class") != "retryable", "failed")
        .when(F.col("recoveries") >= most, "exhausted").when(F.col("__found"), "done").otherwise("replay")
    )
    return found.select(*writes.columns, outcome.alias("outcome"))


def pool_sizes(most_open: Column, most_idle: Column, lifetime: Column) -> tuple[Column, Column, Column]:
    """Connections open, connections idle and seconds of life that a pool gets; null or below 1: not set."""
    given = lambda c, other: F.when(c > 0, c).otherwise(other)
    opened = given(most_open, F.lit(OPEN))
    return opened, given(most_idle, F.least(opened, F.greatest(F.floor(opened / 2), F.lit(IDLE)))), given(lifetime, F.lit(LIFETIME))


def queue_fate(full: Column, severity: Column) -> Column:
    """Of an event: queued; where the queue is full, written at once if it is a warning or an error, else dropped (and counted)."""
    return F.when(~full, "queued").when(severity.isin("WARN", "ERROR"), "written").otherwise("dropped")


def refused(verb: str) -> Column:
    """Why a verb (start, end, cancel_schedule, pause, skip) may not be applied to a task, over columns status, mode, phase;
    empty if it may."""
    status = F.col("status")
    return {
        "start": first_broken((status == "RUNNING", "already running"), (status == "STOPPED", "stopped")),
        "end": first_broken((status != "RUNNING", "not running"), (F.col("mode") != "ALL", "mode"), (F.col("phase") != "INCREMENTAL_STARTED", "phase")),
        "cancel_schedule": first_broken((status != "SCHEDULED", "not scheduled")),
        "pause": F.lit(""),
        "skip": F.lit(""),
    }[verb]


def applied(tasks: DataFrame, verb: str) -> DataFrame:
    """tasks, over columns status, mode, phase, scheduled_from, error, after a verb, with refused: a refused verb changes nothing.
    A cancelled schedule gives back the status before it, or PENDING; skipping an error clears it and leaves the task paused."""
    why = refused(verb)
    to = {"start": F.lit("RUNNING"), "end": F.lit("STOPPED"), "cancel_schedule": F.coalesce("scheduled_from", F.lit("PENDING")), "pause": F.lit("PAUSED"), "skip": F.lit("PAUSED")}[verb]
    done = why == ""
    new = {"refused": why, "status": F.when(done, to).otherwise(F.col("status")), "scheduled_from": F.when(done & F.lit(verb in ("end", "cancel_schedule")), None).otherwise(F.col("scheduled_from")), "error": F.when(done & F.lit(verb == "skip"), "").otherwise(F.col("error"))}
    return tasks.withColumns(new)
