"""Queries of the service around replication: checks, catalogs, logs, recovery, pools and sinks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, control
from ..session import shared_folder
from ..sources.published import PublishedTable
from ..sources.tables import json_lines, table
from .queries import _EVENTS, _INDEXES, _events, _fold_sql, query, values


def _strings(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# ---------------------------------------------------------------- checks

_SERVERS = values("server, log_bin, log_format, row_image, grants_text", "'a', 'ON', 'ROW', 'FULL', 'GRANT ALL PRIVILEGES ON *.*'", "'b', 'OFF', 'ROW', 'FULL', 'GRANT SELECT ON x.*;GRANT REPLICATION SLAVE ON *.*'", "'c', '1', 'MIXED', 'MINIMAL', 'GRANT USAGE ON *.*'", "'d', '1', 'ROW', 'MINIMAL', 'GRANT SELECT, REPLICATION SLAVE, REPLICATION CLIENT ON *.*'")


@query(f"SELECT server, CASE WHEN log_bin NOT IN ('ON', '1') THEN 'log_bin' WHEN log_format <> 'ROW' THEN 'binlog_format' ELSE '' END AS error, row_image <> 'FULL' AS warned FROM ({_SERVERS})")
def log_prerequisites(spark, d):
    return spark.sql(_SERVERS).select("server", checks.log_settings(F.col("log_bin"), F.col("log_format")).alias("error"), (F.col("row_image") != "FULL").alias("warned"))


@query(f"SELECT server, concat_ws(',', {', '.join(f'''CASE WHEN NOT (contains(grants_text, '{g}') OR contains(grants_text, 'ALL PRIVILEGES')) THEN '{g}' END''' for g in checks.GRANTS)}) AS missing FROM ({_SERVERS})")
def grants_missing(spark, d):
    return spark.sql(_SERVERS).select("server", F.array_join(checks.missing_grants(F.split("grants_text", ";")), ",").alias("missing"))


_QUEUES = values(
    "id, brokers_text, routing, topic, prefix, key_mode, batch, acks, mechanism, username, cert, cert_key, tls",
    "1, 'k1:9092,k2:9092', 'single_topic', 't', '', 'pk', 100, -1, '', '', '', '', false", "2, 'k1,', 'single_topic', 't', '', 'pk', 100, 1, '', '', '', '', false",
    "3, 'k1', 'per_table', '', ' ', 'pk', 100, 1, '', '', '', '', false", "4, 'k1', 'other', 't', 'p', 'pk', 100, 1, '', '', '', '', false", "5, 'k1', 'per_table', '', 'p', 'row', 100, 1, '', '', '', '', false",
    "6, 'k1', 'per_table', '', 'p', 'none', 0, 1, '', '', '', '', false", "7, 'k1', 'per_table', '', 'p', 'none', 9, 2, '', '', '', '', false", "8, 'k1', 'per_table', '', 'p', 'none', 9, 0, 'PLAIN', '', '', '', false",
    "9, 'k1', 'per_table', '', 'p', 'none', 9, 0, 'PLAIN', 'u', 'c', '', true", "10, 'k1', 'per_table', '', 'p', 'none', 9, 0, '', '', 'c', 'k', false", "11, 'k1', 'per_table', '', 'p', 'none', 9, 0, '', '', 'c', 'k', true",
)


@query(f"""SELECT id, CASE WHEN list_contains(list_transform(string_split(brokers_text, ','), lambda b: trim(b)), '') THEN 'broker' WHEN routing NOT IN ('single_topic', 'per_table') THEN 'routing'
WHEN routing = 'single_topic' AND trim(topic) = '' THEN 'topic' WHEN routing = 'per_table' AND trim(prefix) = '' THEN 'prefix' WHEN key_mode NOT IN ('pk', 'none') THEN 'key_mode' WHEN batch <= 0 THEN 'batch' WHEN acks NOT IN (-1, 0, 1) THEN 'acks'
WHEN mechanism <> '' AND username = '' THEN 'username' WHEN (cert = '') <> (cert_key = '') THEN 'certificate pair' WHEN cert <> '' AND NOT tls THEN 'tls' ELSE '' END AS broken FROM ({_QUEUES})""")
def message_sink_check(spark, d):
    return spark.sql(_QUEUES).withColumn("brokers", F.split("brokers_text", ",")).select("id", checks.message_sink().alias("broken"))


_HOOKS = values("id, url, timeout_ms, retries, backoff_ms", "1, 'https://h/x', 100, 0, 0", "2, '', 100, 0, 0", "3, 'ftp://h', 1, 0, 0", "4, 'http:///x', 1, 0, 0", "5, 'http://h', 0, 0, 0", "6, 'http://h', 1, -1, 0", "7, 'http://h', 1, 1, -5")


@query(f"""SELECT id, CASE WHEN trim(url) = '' THEN 'url' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'host' WHEN timeout_ms <= 0 THEN 'timeout' WHEN retries < 0 THEN 'retries' WHEN backoff_ms < 0 THEN 'backoff' ELSE '' END AS broken FROM ({_HOOKS})""")
def request_sink_check(spark, d):
    return spark.sql(_HOOKS).select("id", checks.request_sink().alias("broken"))


_SINKS = values("task_id, pos, kind", "'t1', 0, 'MYSQL'", "'t1', 1, 'KAFKA'", "'t2', 0, 'FILE'", "'t3', 0, cast(null as varchar(9))")


@query(f"SELECT task_id, pos, coalesce(kind, 'MYSQL') AS kind, coalesce(kind, 'MYSQL') IN ({_strings(checks.SINK_TYPES)}) AS known FROM ({_SINKS})")
def sink_types(spark, d):
    kind = F.coalesce("kind", F.lit(checks.SINK_TYPES[0]))  # none is named: the relational one
    return spark.sql(_SINKS).select("task_id", "pos", kind.alias("kind"), kind.isin(*checks.SINK_TYPES).alias("known"))


@query(f"""SELECT seq, CASE WHEN seq % 13 = 0 THEN 'execution_id' WHEN seq % 17 = 0 THEN 'message' WHEN code = 'signup' THEN 'severity' WHEN seq % 19 = 0 THEN 'visibility' ELSE '' END AS broken FROM {_EVENTS}""")
def event_validation(spark, d):
    damage = {"execution_id": F.when(F.col("seq") % 13 != 0, F.col("execution_id")), "message": F.when(F.col("seq") % 17 == 0, "").otherwise(F.concat(F.lit("m"), "code")), "event_id": F.col("seq").cast("string"), "severity": F.when(F.col("code") == "signup", "FATAL").otherwise(F.col("severity")), "visibility": F.when(F.col("seq") % 19 == 0, "NONE").otherwise(F.col("visibility"))}
    return _events(spark, d).withColumns(damage).select("seq", checks.event().alias("broken"))


_CODES = values("code", "'TASK_STARTED'", "'PHASE_FULL_DONE'", "'READ_RETRY_EXHAUSTED'", "'READ_RETRY'", "'TASK_CONFIG_EFFECTIVE'", "'SOURCE_POOL_WAIT_HIGH'")


@query(f"SELECT code, code IN ({_strings(checks.ALWAYS_SHOWN)}) OR starts_with(code, 'PHASE_') OR ends_with(code, '_EXHAUSTED') AS shown FROM ({_CODES})")
def event_never_suppressed(spark, d):
    return spark.sql(_CODES).select("code", checks.always_shown(F.col("code")).alias("shown"))


_STARTS = values(
    "id, status, mode, phase, full_done, relational, checking, old_marks, drop_first", "1, 'COMPLETED', 'FULL', 'FULL_COMPLETED', true, true, false, 0, false", "2, 'RUNNING', 'ALL', 'FULL_STARTED', false, true, false, 2, false",
    "3, 'STOPPED', 'INCREMENTAL', '', false, true, false, 0, false", "4, 'STOPPED', 'ALL', 'INCREMENTAL_STARTED', true, true, true, 0, false", "5, 'COMPLETED', 'all', 'FULL_FAILED', false, false, false, 0, false", "6, 'STOPPED', 'FULL', 'FULL_FAILED', false, true, false, 0, true",
    "7, 'STOPPED', 'INCREMENTAL', 'INCREMENTAL_STARTED', true, false, false, 0, false", "8, 'PAUSED', 'FULL', 'FULL_FAILED', false, true, false, 0, false",
)


@query(f"SELECT id, CASE WHEN status NOT IN ('COMPLETED', 'STOPPED') THEN 'status' WHEN mode NOT IN ('FULL', 'ALL') THEN 'mode' WHEN NOT full_done THEN 'full load' WHEN NOT relational THEN 'target' WHEN checking THEN 'running' ELSE '' END AS broken FROM ({_STARTS})")
def comparison_allowed(spark, d):
    return spark.sql(_STARTS).select("id", checks.comparison().alias("broken"))


@query(f"SELECT id, CASE WHEN drop_first OR phase NOT IN ('FULL_STARTED', 'FULL_FAILED') OR upper(mode) NOT IN ('FULL', 'ALL') THEN '' WHEN upper(mode) = 'ALL' AND old_marks > 0 THEN 'old marks' ELSE 'interrupted' END AS broken FROM ({_STARTS})")
def restart_allowed(spark, d):
    return spark.sql(_STARTS).select("id", checks.restart().alias("broken"))


@query(f"""SELECT id, CASE WHEN upper(mode) = 'INCREMENTAL' THEN CASE WHEN full_done THEN 'incremental' ELSE 'refused: no full load' END WHEN NOT relational THEN 'refused: target'
WHEN upper(mode) = 'FULL' THEN 'full' WHEN full_done THEN 'incremental' ELSE 'full, then incremental' END AS plan FROM ({_STARTS})""")
def run_mode_plan(spark, d):
    return spark.sql(_STARTS).select("id", checks.run_plan().alias("plan"))


# ---------------------------------------------------------------- catalogs and indexes

_CATALOG = values("schema_name, table_name, table_type", "'shop', 'orders', 'BASE TABLE'", "'shop', 'v', 'VIEW'", "'mysql', 'user', 'BASE TABLE'", "'SYS', 'x', 'BASE TABLE'", "'shop', 'items', 'BASE TABLE'")


@query(f"SELECT schema_name, table_name FROM ({_CATALOG}) WHERE table_type = 'BASE TABLE' AND lower(schema_name) NOT IN ({_strings(control.SYSTEM_SCHEMAS)}) ORDER BY table_name")
def base_tables(spark, d):
    return control.base_tables(spark.sql(_CATALOG)).select("schema_name", "table_name").orderBy("table_name")


@query("""SELECT count(*) AS tables, count(*) FILTER (WHERE n IS NULL) AS unknown, cast(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT (SELECT count(*) FROM orders) AS n UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM customer UNION ALL SELECT NULL)""")
def estimated_rows_total(spark, d):
    """Counts come out of Parquet footers: no column is read."""
    known = [table(spark, d, t).agg(F.count("*").alias("n")) for t in ("orders", "lineitem", "customer")]
    all_ = known[0].unionByName(known[1]).unionByName(known[2]).unionByName(spark.sql("SELECT cast(null AS bigint) AS n"))
    return all_.agg(F.count("*").alias("tables"), F.count(F.when(F.col("n").isNull(), 1)).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query(f"SELECT table_name, index_name, string_agg(column_name, ',' ORDER BY seq) AS cols FROM ({_INDEXES}) WHERE column_name IS NOT NULL GROUP BY 1, 2")
def index_column_order(spark, d):
    return control.index_columns(spark.sql(_INDEXES))


_BASE = values("schema_name, table_name, index_name, cols", "'s', 'a', 'k1', 'x'", "'s', 'b', 'k1', 'y'")
_EXTRA = values("schema_name, table_name, index_name, cols", "'s', 'a', 'k1', 'other'", "'s', 'a', 'k2', 'z'", "'s', 'a', '', 'q'", "'s', 'c', 'k3', 'w'")


@query(f"SELECT * FROM ({_BASE}) UNION ALL SELECT * FROM ({_EXTRA}) e WHERE index_name <> '' AND NOT EXISTS (SELECT 1 FROM ({_BASE}) b WHERE b.schema_name = e.schema_name AND b.table_name = e.table_name AND b.index_name = e.index_name)")
def pending_index_merge(spark, d):
    return control.merged_indexes(spark.sql(_BASE), spark.sql(_EXTRA))


_DEFER = "SELECT m AS mode, u AS is_unique, i AS identity, o AS optimize FROM (SELECT 'ALL' AS m UNION ALL SELECT 'FULL') CROSS JOIN (SELECT true AS u UNION ALL SELECT false) CROSS JOIN (SELECT true AS i UNION ALL SELECT false) CROSS JOIN (SELECT true AS o UNION ALL SELECT false)"


@query(f"SELECT *, NOT identity AND (optimize OR (mode = 'ALL' AND is_unique)) AS deferred FROM ({_DEFER})")
def index_defer_choice(spark, d):
    return spark.sql(_DEFER).withColumn("deferred", control.index_deferred(F.col("mode"), F.col("is_unique"), F.col("identity"), F.col("optimize")))


_LINES = values("line", "'  UNIQUE KEY `uk_a` (`a`),'", "'KEY `k b` (`b`(10))'", "'PRIMARY KEY (`id`)'", "'`key` int'", "'FULLTEXT INDEX `ft` (`t`)'", "'KEY plain (a)'")


@query(f"SELECT line, regexp_extract(trim(line), '^((UNIQUE|FULLTEXT|SPATIAL) )?(KEY|INDEX) `([^`]+)`', 4) AS index_name FROM ({_LINES})")
def ddl_index_names(spark, d):
    return spark.sql(_LINES).select("line", control.index_name(F.col("line")).alias("index_name"))


_LISTS = values("task_id, tables_text", "'t1', 'a, b,a ,c,b'", "'t2', 'x'", "'t3', ' , y,'")


@query(f"SELECT task_id, string_agg(t, ',' ORDER BY i) AS tables FROM (SELECT task_id, t, min(i) AS i FROM (SELECT task_id, trim(unnest(string_split(tables_text, ','))) AS t, unnest(range(len(string_split(tables_text, ',')))) AS i FROM ({_LISTS})) WHERE t <> '' GROUP BY 1, 2) GROUP BY 1")
def table_list_resolved(spark, d):
    names = F.filter(F.transform(F.split("tables_text", ","), lambda t: F.trim(t)), lambda t: t != "")
    return spark.sql(_LISTS).select("task_id", F.array_join(F.array_distinct(names), ",").alias("tables"))


# ---------------------------------------------------------------- logs, positions, recovery


@query(f"SELECT seq, task_id, severity, code FROM {_EVENTS}")
def event_log_roundtrip(spark, d):
    """Events appended as JSON lines to a log folder, and read back as a log is."""
    path = shared_folder(spark, "log")
    rows = _events(spark, d).select("seq", "task_id", "severity", "code")
    rows.write.json(path)
    return json_lines(spark, path, "seq long, task_id string, severity string, code string")


@query(f"SELECT n.task_id, n.seq AS was, coalesce(top, 0) + row_number() OVER (PARTITION BY n.task_id ORDER BY n.seq) AS seq FROM {_EVENTS} n LEFT JOIN (SELECT task_id, max(seq) AS top FROM {_EVENTS} WHERE severity <> 'ERROR' GROUP BY 1) t ON t.task_id = n.task_id WHERE severity = 'ERROR'")
def event_append(spark, d):
    rows = _events(spark, d)
    new = rows.where("severity = 'ERROR'").select("task_id", F.col("seq").alias("was"))
    return control.appended(rows.where("severity <> 'ERROR'"), new, "task_id", "was").select("task_id", "was", "seq")


_MANIFEST = values("task_id, table_name, phase, expected", "'t1', 'a', 'PUBLISHED', 2", "'t1', 'b', 'PUBLISHED', 2", "'t2', 'a', 'PUBLISHED', 2", "'t3', 'a', 'PUBLISHED', 0", "'t3', 'b', 'COPYING', 0", "'t4', 'a', cast(null as varchar(9)), 1")


@query(f"SELECT task_id, published, n - published AS pending, published = n AND (e <= 0 OR n >= e) AS complete FROM (SELECT task_id, count(*) FILTER (WHERE phase = 'PUBLISHED') AS published, count(*) AS n, max(expected) AS e FROM ({_MANIFEST}) GROUP BY 1)")
def recovery_split(spark, d):
    return control.recovery(spark.sql(_MANIFEST))


_STEPS = values("table_name, step, attempt, phase", "'a', 1, 1, 'COPYING'", "'a', 2, 1, 'PUBLISHED'", "'a', 3, 2, 'FAILED'", "'b', 1, 1, 'COPYING'", "'b', 2, 2, 'SNAPSHOT_OPENING'", "'c', 1, 1, 'FAILED'")


@query(f"SELECT table_name, CASE WHEN bool_or(phase = 'PUBLISHED') THEN 'PUBLISHED' ELSE arg_max(phase, step) END AS phase, max(attempt) AS attempt FROM ({_STEPS}) GROUP BY 1")
def table_phase_final(spark, d):
    return control.final_phase(spark.sql(_STEPS))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def checkpoint_latest(spark, d):
    """The newest saved value of each key."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query(_fold_sql("SELECT cast(user_id % 5 AS VARCHAR) AS g, event_id AS k, event_id * 3 AS s FROM events", "(r.s >= f.first + 5)") + " SELECT g, min(k) AS k, min(s) AS s FROM f GROUP BY g, batch")
def position_saves(spark, d):
    """Positions that are written when two writes are 5 s apart."""
    rows = table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("g"), F.col("event_id").alias("k"), (F.col("event_id") * 3).alias("s"))
    return control.spaced(rows, "g", "k", "s", 5)


_GENERATIONS = values("task_id, generation", "'task_0', 2", "'task_1', 1")


@query(f"SELECT seq, e.task_id FROM {_EVENTS} e JOIN ({_GENERATIONS}) g ON g.task_id = e.task_id AND 1 + seq % 2 = generation")
def event_generation_guard(spark, d):
    """Events of deleted tasks, or of a task's former life, are left out."""
    rows = _events(spark, d).withColumn("generation", (1 + F.col("seq") % 2).cast("int"))
    return rows.join(F.broadcast(spark.sql(_GENERATIONS)), ["task_id", "generation"], "left_semi").select("seq", "task_id")


# ---------------------------------------------------------------- pools and counters

_POOL = "(SELECT cast(user_id % 3 AS VARCHAR) AS g, event_id AS k, event_id * 5 AS s, event_id * 7 % 20 AS in_use, 20 AS most, event_id // 40 AS waits FROM events)"


def _pool(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("g"), k.alias("k"), (k * 5).alias("s"), (k * 7 % 20).alias("in_use"), F.lit(20).alias("most"), F.floor(k / 40).alias("waits"))


@query(_fold_sql(f"SELECT g, k, s FROM (SELECT *, waits - lag(waits, 1, 0) OVER (PARTITION BY g ORDER BY k) AS delta FROM {_POOL}) WHERE delta > 0 OR in_use / 20.0 >= 0.85", "(r.s >= f.first + 30)") + " SELECT g, min(k) AS k, min(s) AS s FROM f GROUP BY g, batch")
def pool_pressure(spark, d):
    return control.pool_pressure(_pool(spark, d), "g", "k", "s")


@query(f"SELECT g, k, CASE WHEN waits < w THEN waits ELSE waits - w END AS waits, CASE WHEN in_use < u THEN in_use ELSE in_use - u END AS in_use FROM (SELECT *, lag(waits, 1, 0) OVER (PARTITION BY g ORDER BY k) AS w, lag(in_use, 1, 0) OVER (PARTITION BY g ORDER BY k) AS u FROM {_POOL})")
def counter_deltas(spark, d):
    return control.counter_deltas(_pool(spark, d), "g", "k", ["waits", "in_use"])


@query("SELECT event_id, CASE WHEN event_id % 401 >= 300 THEN 'TIMEOUT' WHEN event_id % 401 >= 30 THEN 'SLOW' ELSE '' END AS class FROM events")
def slow_queries(spark, d):
    return table(spark, d, "events").select("event_id", control.query_class(F.col("event_id") % 401).alias("class"))


@query("SELECT i AS wait, CASE WHEN i = 0 THEN 15.0 WHEN i = 1 THEN 1.0 ELSE greatest(least(i / 3.0, 15.0), 1.0) END AS seconds FROM range(61) AS r(i)")
def heartbeat_interval(spark, d):
    return spark.range(61).select(F.col("id").alias("wait"), control.heartbeat_seconds(F.col("id")).alias("seconds"))


# ---------------------------------------------------------------- scalars and sinks

_PAIRS = values("a, b", "'9', '10'", "'10', '10'", "'x9', 'x10'", "'9', 'x'", "cast(null as varchar(9)), '0'", "'-3', '2'", "'99999999999999999999', '5'")


@query(f"""SELECT a, b, CASE WHEN try_cast(a AS BIGINT) IS NOT NULL AND try_cast(b AS BIGINT) IS NOT NULL THEN cast(sign(try_cast(a AS BIGINT) - try_cast(b AS BIGINT)) AS INTEGER)
WHEN coalesce(a, '') < coalesce(b, '') THEN -1 WHEN coalesce(a, '') > coalesce(b, '') THEN 1 ELSE 0 END AS ordered FROM ({_PAIRS})""")
def key_compare(spark, d):
    return spark.sql(_PAIRS).select("a", "b", control.key_order(F.col("a"), F.col("b")).alias("ordered"))


_KEYS = values("name", "'shop.orders'", "'a.b.c'", "'.x'", "'x.'", "'plain'", "''")


@query(f"SELECT name, CASE WHEN ok THEN substr(name, 1, instr(name, '.') - 1) END AS schema_name, CASE WHEN ok THEN substr(name, instr(name, '.') + 1) END AS table_name FROM (SELECT name, instr(name, '.') > 1 AND instr(name, '.') < length(name) AS ok FROM ({_KEYS}))")
def table_key_split(spark, d):
    schema, name = control.split_key(F.col("name"))
    return spark.sql(_KEYS).select("name", schema.alias("schema_name"), name.alias("table_name"))


@query("SELECT p_partkey, p_name AS opened, true AS sealed FROM part")
def encrypt_roundtrip(spark, d):
    """Names sealed under a key that is padded to 32 bytes, and opened again; plain text passes through."""
    sealed = text.sealed(F.col("p_name"), "a short key")
    rows = table(spark, d, "part").select("p_partkey", sealed.alias("s"), "p_name")
    return rows.select("p_partkey", text.opened(F.col("s"), "a short key").alias("opened"), (F.col("s").startswith("ENC~") & (text.opened(F.col("p_name"), "a short key") == F.col("p_name"))).alias("sealed"))


_SECRETS = values("id, incoming, stored", "1, '******', 'old'", "2, 'new', 'old'", "3, '******', cast(null as varchar(9))", "4, '', 'old'")


@query(f"SELECT id, CASE WHEN incoming = '******' AND stored IS NOT NULL THEN stored ELSE incoming END AS updated, CASE WHEN incoming IN ('******', '') AND stored IS NOT NULL THEN stored ELSE incoming END AS cloned FROM ({_SECRETS})")
def secret_preserved(spark, d):
    kept = lambda blank: control.kept_secret(F.col("incoming"), F.col("stored"), text.MASK, blank)
    return spark.sql(_SECRETS).select("id", kept(False).alias("updated"), kept(True).alias("cloned"))


_ENV = values("name, in_env, in_file, by_default", "'port', '8081', '8080', '80'", "'host', '', 'h', 'localhost'", "'level', cast(null as varchar(9)), cast(null as varchar(9)), 'info'")


@query(f"SELECT name, coalesce(nullif(in_env, ''), in_file, by_default) AS value FROM ({_ENV})")
def config_overrides(spark, d):
    return spark.sql(_ENV).select("name", F.coalesce(F.when(F.col("in_env") != "", F.col("in_env")), "in_file", "by_default").alias("value"))


@query(values("mode, statement", "'plain', 'INSERT INTO `t` (`id`, `a`) VALUES (?, ?), (?, ?)'", "'upsert', 'INSERT INTO `t` (`id`, `a`) VALUES (?, ?), (?, ?) ON DUPLICATE KEY UPDATE `a` = VALUES(`a`)'", "'ignore', 'INSERT IGNORE INTO `t` (`id`, `a`) VALUES (?, ?), (?, ?)'"))
def insert_statements(spark, d):
    return spark.createDataFrame([(m, control.insert_text("t", ["id", "a"], ["id"], 2, m)) for m in ("plain", "upsert", "ignore")], "mode string, statement string")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def staged_publish(spark, d):
    """A table loaded to staging and published twice; readers see the newest whole version."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target = PublishedTable(spark, shared_folder(spark, "published"))
    target.publish(rows.withColumn("o_totalprice", F.lit(0.0)))
    target.publish(rows)
    return target.read()
