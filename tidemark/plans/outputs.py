"""Queries of what a replication service writes beside tables: definitions of targets, audit log, metrics, flushes; chunk plans over
keys of any type; each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import audit, batching, chunks, ddl, metrics
from ..session import shared_folder
from ..sources.tables import table
from .queries import query, values

# ---------------------------------------------------------------- definitions

_DEFINITIONS = values(
    "id, schema_name, table_name, source_schema, source_table, mode, optimize, drop_first, database_there, table_there, d",
    "1, 's', 't', 'src', 'o', 'ALL', false, false, true, false, 'CREATE TABLE `o` (|  `id` bigint NOT NULL AUTO_INCREMENT,|  `a` int,|  PRIMARY KEY (`id`),|  UNIQUE KEY `u` (`a`),|  KEY `k` (`id`,`a`),|  key `z` (`a`) |) ENGINE=InnoDB'",
    "2, 's', 'p', 'src', 'p', 'FULL', true, true, false, true, 'CREATE TABLE `p` (|  `key` int,|  FULLTEXT INDEX `f` (`key`),|  SPATIAL KEY `z` (`g`)|)'",
    "3, 's', 'q', 'src', 'q', 'FULL', false, false, false, false, 'CREATE TABLE `q` (|  `x` int|)'", "4, 's', 'r', 'src', 'r', 'FULL', true, false, true, true, 'KEY `a` (`b`)'",
)
_AUTO = "list_transform(list_filter(lines, lambda x: regexp_matches(trim(x), '^`[^`]*`') AND contains(upper(x), 'AUTO_INCREMENT')), lambda x: regexp_extract(x, '`[^`]*`'))"


def _stripped_sql(names: str) -> str:
    """SQL of definitions without the indexes that `names`, a condition on the line x, chooses."""
    goes = f"i > 1 AND i < len(lines) AND regexp_matches(trim(x), '^((UNIQUE|FULLTEXT|SPATIAL) )?(KEY|INDEX) ', 'i') AND len(list_filter(auto, lambda a: contains(x, a))) = 0 AND {names}"
    return f"""SELECT *, regexp_replace(array_to_string(list_filter(lines, lambda x, i: NOT ({goes})), chr(10)), ',?[ \\t]*(\\n\\s*\\))', '\\1', 'g') AS stripped
FROM (SELECT *, {_AUTO} AS auto FROM (SELECT *, string_split(d, '|') AS lines FROM ({_DEFINITIONS})))"""


def _definitions(spark):
    return spark.sql(_DEFINITIONS).withColumn("definition", F.replace("d", F.lit("|"), F.lit("\n")))


@query(f"SELECT id, stripped FROM ({_stripped_sql('true')})")
def ddl_without_indexes(spark, d):
    return _definitions(spark).select("id", ddl.without_indexes(F.col("definition")).alias("stripped"))


_NAME = "'`' || schema_name || '`.`' || table_name || '`'"
_NAMED = "regexp_extract(x, '`([^`]*)`', 1) IN (''u'', ''z'', ''k'')".replace("''", "'")


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN NOT database_there THEN 'CREATE DATABASE IF NOT EXISTS `' || schema_name || '` {ddl.DATABASE_OPTIONS}' END,
CASE WHEN drop_first THEN 'DROP TABLE IF EXISTS ' || {_NAME} END, CASE WHEN table_there AND NOT drop_first THEN NULL WHEN optimize OR mode = 'ALL' THEN 'CREATE TABLE ' || {_NAME} || ' ' || CASE WHEN contains(stripped, '(') THEN substr(stripped, strpos(stripped, '(')) ELSE stripped END
ELSE 'CREATE TABLE ' || {_NAME} || ' LIKE `' || source_schema || '`.`' || source_table || '`' END], lambda s: s IS NOT NULL), ';') AS statements FROM ({_stripped_sql(_NAMED)})""")
def ddl_target_statements(spark, d):
    rows = _definitions(spark).withColumn("deferred", F.array(F.lit("u"), F.lit("z"), F.lit("k")))
    return rows.select("id", F.array_join(ddl.target_statements(), ";").alias("statements"))


# ---------------------------------------------------------------- audit log

_AUDIT = "SELECT event_id, user_id % 3 AS t, upper(event_type) AS kind, TIMESTAMP '2024-03-01 00:00:00' + to_minutes(cast(event_id % 9000 AS INTEGER)) AS seen FROM events"


@query(f"SELECT cast(event_id AS VARCHAR) AS position, strftime(seen, '%Y-%m-%d %H:%M') AS seen, kind <> 'ERROR' AS success, CASE WHEN kind = 'ERROR' THEN 'e' || event_id END AS error_msg, nullif(event_id % 2, 0) AS rows_affected FROM ({_AUDIT}) WHERE t = 1 AND kind IN ('ERROR') AND seen >= TIMESTAMP '2024-03-02 08:30:00' AND seen <= TIMESTAMP '2024-03-05 17:00:00'")
def audit_appended(spark, d):
    """Events appended to an audit log in two goes, then one task's errors in a range of time found in it."""
    e = table(spark, d, "events")
    at = F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("event_id") % 9000).cast("int"))
    kind = F.upper("event_type")
    rows = e.select(
        at.alias("timestamp"), F.concat(F.lit("task_"), F.col("user_id") % 3).alias("task_id"), kind.alias("event_type"), F.lit("").alias("table_name"), F.lit(None).cast("string").alias("schema"),
        F.col("event_id").cast("string").alias("position"), (kind != "ERROR").alias("success"), F.when(kind == "ERROR", F.concat(F.lit("e"), "event_id")).otherwise("").alias("error_msg"),
        F.create_map(F.lit("k"), F.lit("v")).alias("details"), (F.col("event_id") % 2).alias("rows_affected"),
    )
    path = shared_folder(spark, "audit")
    audit.append(rows.where("success"), path)
    audit.append(rows.where("not success"), path)
    found = audit.find(spark, path, "task_1", "ERROR", datetime(2024, 3, 2, 8, 30), datetime(2024, 3, 5, 17))
    return found.select("position", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("seen"), "success", "error_msg", "rows_affected")


# ---------------------------------------------------------------- metrics

_BOUNDS = " UNION ALL ".join(f"SELECT '{b}' AS le, cast({b} AS DOUBLE) AS b" for b in metrics.BOUNDS)
_MEASURES = "(SELECT event_id, event_type, cast(value AS DECIMAL(18,6)) AS v FROM events WHERE value IS NOT NULL)"


def _measures(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("v", F.col("value").cast("decimal(18,6)"))
    one = lambda name, kind, v: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), v.alias("value"))
    counted = F.when(F.col("event_type") == "error", one("errors_total", "counter", F.lit(1).cast("decimal(18,6)")))
    return e.select(F.col("event_id").alias("ord"), F.explode(F.array_compact(F.array(counted, one("lag_seconds", "gauge", F.col("v")), one("duration_seconds", "histogram", F.col("v"))))).alias("m")).select("ord", "m.*")


@query(f"""SELECT 'errors_total' AS sample, cast(count(*) AS DOUBLE) AS value FROM {_MEASURES} WHERE event_type = 'error' HAVING count(*) > 0 UNION ALL SELECT 'lag_seconds', cast(arg_max(v, event_id) AS DOUBLE) FROM {_MEASURES} UNION ALL SELECT 'duration_seconds_sum', cast(sum(v) AS DOUBLE) FROM {_MEASURES}
UNION ALL SELECT 'duration_seconds_count', count(*) FROM {_MEASURES} UNION ALL SELECT 'duration_seconds_bucket{{le="+Inf"}}', count(*) FROM {_MEASURES} UNION ALL SELECT 'duration_seconds_bucket{{le="' || le || '"}}', count(*) FILTER (WHERE cast(v AS DOUBLE) <= b) FROM {_MEASURES}, ({_BOUNDS}) GROUP BY le""")
def metric_samples(spark, d):
    return metrics.samples(_measures(spark, d))


# ---------------------------------------------------------------- flushes


@query("SELECT event_id, tick, (row_number() OVER (PARTITION BY event_type, tick ORDER BY event_id) - 1) // 7 AS part FROM (SELECT event_id, event_type, event_id // 60 AS tick FROM events)")
def buffered_flushes(spark, d):
    """Event ids stand for seconds."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return batching.buffered(e, "event_type", "event_id", "event_id", 7, 60).select("event_id", "tick", "part")


# ---------------------------------------------------------------- chunk plans over other keys


@query("SELECT rn // 40 AS boundary, c_name AS key FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS rn FROM customer) WHERE rn % 40 = 0 AND rn <= 40 * 32")
def chunk_nth_row_text_key(spark, d):
    return chunks.nth_row(table(spark, d, "customer"), "c_name", 40, 32)


@query("SELECT rn // 500 AS boundary, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn % 500 = 0 AND rn <= 500 * 64")
def chunk_nth_row_composite_key(spark, d):
    return chunks.nth_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 500, 64)
