"""Queries of how a load's parts work together and of task verbs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coordination
from ..sources.tables import table
from .queries import _EVENTS, _events, query, values

# ---------------------------------------------------------------- errors and outcomes

_ERRORS = values(
    "id, writer, reader, parent, own, stop", "1, 'disk full', 'gone', 'paused', null, 'paused'", "2, 'canceled', 'gone', 'paused', null, null", "3, 'canceled', 'canceled', 'lock lost', 'own', 'paused'",
    "4, 'canceled', null, 'canceled', null, 'paused'", "5, null, 'deadline', null, null, null", "6, null, null, null, null, 'paused'", "7, 'deadline', 'canceled', null, 'own', 'paused'", "8, 'canceled', null, null, null, 'shutdown'",
)
_PLAIN = "('canceled', 'deadline')"


@query(f"""SELECT id, CASE WHEN e IN {_PLAIN} AND stop IS NOT NULL THEN stop ELSE e END AS error FROM (SELECT id, stop, CASE WHEN writer NOT IN {_PLAIN} THEN writer WHEN reader NOT IN {_PLAIN} THEN reader
WHEN parent IS NOT NULL THEN parent WHEN own IS NOT NULL THEN own WHEN writer IS NOT NULL THEN writer ELSE reader END AS e FROM ({_ERRORS}))""")
def run_error(spark, d):
    cancelled = F.array(F.lit("canceled"), F.lit("deadline"))
    return spark.sql(_ERRORS).select("id", coordination.reported_error(*[F.col(c) for c in ("writer", "reader", "parent", "own")], cancelled, F.col("stop")).alias("error"))


_SLOW = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('c', o_custkey) ELSE '' END AS chunk, CASE WHEN o_orderkey % 3 = 0 THEN '[7]' END AS start_text FROM orders"


@query(f"SELECT o_orderkey, 'source query timeout after 31s (limit 30s): table=shop.orders' || CASE WHEN chunk <> '' THEN ' chunk=' || chunk ELSE '' END || ' phase=keyset' || coalesce(' start=' || start_text, '') AS message FROM ({_SLOW})")
def read_timeout_message(spark, d):
    o = table(spark, d, "orders")
    chunk = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c"), "o_custkey")).otherwise("")
    rows = o.select("o_orderkey", chunk.alias("chunk"), F.when(F.col("o_orderkey") % 3 == 0, "[7]").alias("start_text"), *[F.lit(v).alias(c) for c, v in (("elapsed", "31s"), ("timeout", "30s"), ("schema_name", "shop"), ("table_name", "orders"), ("phase", "keyset"), ("cursor_text", ""), ("end_text", ""))])
    return rows.select("o_orderkey", coordination.timeout_text().alias("message"))


_WRITES = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'm' || o_orderkey END AS marker, o_orderkey % 3 = 0 AS committed, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'retryable' ELSE 'fatal' END AS error_class, o_custkey % 4 AS recoveries FROM orders"


@query(f"""SELECT o_orderkey, CASE WHEN marker = '' THEN 'refused' WHEN committed THEN 'done' WHEN error_class = 'fatal' THEN 'failed' WHEN recoveries >= 3 THEN 'exhausted' WHEN marker IN (SELECT 'm' || l_orderkey FROM lineitem WHERE l_linenumber >= 4) THEN 'done' ELSE 'replay' END AS outcome FROM ({_WRITES})""")
def write_outcomes(spark, d):
    """Writes whose commit may have been lost are looked up by their marks, here orders with a fourth line."""
    key = F.col("o_orderkey")
    writes = table(spark, d, "orders").select(
        key, F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("m"), key)).alias("marker"), (key % 3 == 0).alias("committed"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "retryable").otherwise("fatal").alias("error_class"), (F.col("o_custkey") % 4).alias("recoveries"),
    )
    markers = table(spark, d, "lineitem").where("l_linenumber >= 4").select(F.concat(F.lit("m"), "l_orderkey").alias("marker"))
    return coordination.write_outcome(writes, markers, 3).select("o_orderkey", "outcome")


# ---------------------------------------------------------------- readiness, queues, pools

_STEPS = "SELECT user_id AS part, event_id, CASE WHEN event_type = 'click' THEN 'enqueued' WHEN event_type = 'signup' THEN 'read_done' WHEN event_type = 'error' THEN 'aborted' ELSE 'committed' END AS kind, event_id % 3 AS n FROM events"


@query(f"""SELECT part, min(event_id) FILTER (WHERE ended AND total - least(0, low) = 0 AND kind <> 'enqueued' AND NOT (kind = 'committed' AND n = 0)) AS ready FROM
(SELECT *, min(total) OVER w AS low FROM (SELECT *, sum(CASE kind WHEN 'enqueued' THEN 1 WHEN 'aborted' THEN -1 WHEN 'committed' THEN -n ELSE 0 END) OVER w AS total, bool_or(kind = 'read_done') OVER w AS ended FROM ({_STEPS})
WINDOW w AS (PARTITION BY part ORDER BY event_id)) WINDOW w AS (PARTITION BY part ORDER BY event_id)) GROUP BY part""")
def table_ready_at(spark, d):
    kind = F.when(F.col("event_type") == "click", "enqueued").when(F.col("event_type") == "signup", "read_done").when(F.col("event_type") == "error", "aborted").otherwise("committed")
    steps = table(spark, d, "events").select(F.col("user_id").alias("part"), "event_id", kind.alias("kind"), (F.col("event_id") % 3).alias("n"))
    return coordination.ready_at(steps, "part", "event_id", "kind", "n")


@query(f"SELECT task_id, count(*) FILTER (WHERE seq % 5 <> 0) AS queued, count(*) FILTER (WHERE seq % 5 = 0 AND severity <> 'INFO') AS written, count(*) FILTER (WHERE seq % 5 = 0 AND severity = 'INFO') AS dropped FROM {_EVENTS} GROUP BY task_id")
def event_queue_fates(spark, d):
    fate = coordination.queue_fate(F.col("seq") % 5 == 0, F.col("severity"))
    counted = [F.count_if(F.col("fate") == f).alias(f) for f in ("queued", "written", "dropped")]
    return _events(spark, d).withColumn("fate", fate).groupBy("task_id").agg(*counted)


_POOLS = values("id, opened, idle, life", "1, 0, 0, 0", "2, 100, 0, 60", "3, 8, 0, -1", "4, 20, 5, 0", "5, cast(null as integer), cast(null as integer), cast(null as integer)", "6, 33, 0, 1")


@query(f"SELECT id, o AS opened, cast(CASE WHEN idle > 0 THEN idle ELSE least(o, greatest(o // 2, 16)) END AS BIGINT) AS idle, CASE WHEN life > 0 THEN life ELSE 180 END AS life FROM (SELECT *, CASE WHEN opened > 0 THEN opened ELSE 32 END AS o FROM ({_POOLS}))")
def pool_sizes(spark, d):
    opened, idle, life = coordination.pool_sizes(F.col("opened"), F.col("idle"), F.col("life"))
    return spark.sql(_POOLS).select("id", opened.alias("opened"), idle.cast("long").alias("idle"), life.alias("life"))


# ---------------------------------------------------------------- verbs

_STATES = ("PENDING", "SCHEDULED", "RUNNING", "PAUSED", "FAILED", "COMPLETED", "STOPPED")
_STATED = f"SELECT o_orderkey, [{', '.join(repr(s) for s in _STATES)}][o_orderkey % 7 + 1] AS status, CASE o_custkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'FULL' ELSE 'INCREMENTAL' END AS mode, CASE WHEN o_custkey % 2 = 0 THEN 'INCREMENTAL_STARTED' ELSE 'FULL_STARTED' END AS phase, CASE WHEN o_custkey % 5 = 0 THEN 'PAUSED' END AS scheduled_from FROM orders"


def _verbs(spark, d, verb: str):
    status = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    mode = F.when(F.col("o_custkey") % 3 == 0, "ALL").when(F.col("o_custkey") % 3 == 1, "FULL").otherwise("INCREMENTAL")
    phase = F.when(F.col("o_custkey") % 2 == 0, "INCREMENTAL_STARTED").otherwise("FULL_STARTED")
    tasks = table(spark, d, "orders").select("o_orderkey", status.alias("status"), mode.alias("mode"), phase.alias("phase"), F.when(F.col("o_custkey") % 5 == 0, "PAUSED").alias("scheduled_from"), F.lit("e").alias("error"))
    return coordination.applied(tasks, verb).select("o_orderkey", "refused", "status", "scheduled_from", "error")


def _verb_sql(why: str, status: str, schedule: str = "scheduled_from", error: str = "'e'") -> str:
    return f"SELECT o_orderkey, refused, CASE WHEN refused = '' THEN {status} ELSE status END AS status, CASE WHEN refused = '' THEN {schedule} ELSE scheduled_from END AS scheduled_from, {error} AS error FROM (SELECT *, {why} AS refused FROM ({_STATED}))"


@query(_verb_sql("CASE status WHEN 'RUNNING' THEN 'already running' WHEN 'STOPPED' THEN 'stopped' ELSE '' END", "'RUNNING'"))
def task_start(spark, d):
    return _verbs(spark, d, "start")


@query(_verb_sql("CASE WHEN status <> 'RUNNING' THEN 'not running' WHEN mode <> 'ALL' THEN 'mode' WHEN phase <> 'INCREMENTAL_STARTED' THEN 'phase' ELSE '' END", "'STOPPED'", "NULL"))
def task_end(spark, d):
    return _verbs(spark, d, "end")


@query(_verb_sql("CASE WHEN status = 'SCHEDULED' THEN '' ELSE 'not scheduled' END", "coalesce(scheduled_from, 'PENDING')", "NULL"))
def task_cancel_schedule(spark, d):
    return _verbs(spark, d, "cancel_schedule")


@query(_verb_sql("''", "'PAUSED'"))
def task_pause(spark, d):
    return _verbs(spark, d, "pause")


@query(_verb_sql("''", "'PAUSED'", error="''"))
def task_skip_error(spark, d):
    return _verbs(spark, d, "skip")
