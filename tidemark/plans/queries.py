"""The engine's queries, each with SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import batching, catalog, changelog, chunks, eventlog, keyset, replay, report, tasks
from ..sources.tables import change_log, drifted_target, range_scan, table
from ..streaming import apply

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


# ---------------------------------------------------------------- keyset pages


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def keyset_page_first(spark, d):
    return keyset.page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], limit=0)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 500")
def keyset_page_next(spark, d):
    return keyset.page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], [700], limit=500)


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (10, 2) ORDER BY conv_id, turn LIMIT 50")
def keyset_composite_next(spark, d):
    return keyset.page(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], [10, 2], limit=50)


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn > 1)) AND (conv_id < 15 OR (conv_id = 15 AND turn <= 2)) ORDER BY conv_id, turn LIMIT 1000")
def keyset_bounded(spark, d):
    return keyset.page(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], [3, 1], [15, 2])


@query("SELECT count(*) FILTER (WHERE (conv_id, turn) <= (12, 1)) AS a, count(*) FILTER (WHERE (conv_id, turn) <= (12, 1)) AS b, cast(0 AS BIGINT) AS differ FROM conversations")
def keyset_upper_forms_equal(spark, d):
    a, b = keyset.up_to(["conv_id", "turn"], [12, 1]), keyset.up_to_by_equality(["conv_id", "turn"], [12, 1])
    return table(spark, d, "conversations").agg(F.count(F.when(a, 1)).alias("a"), F.count(F.when(b, 1)).alias("b"), F.count(F.when(a != b, 1)).alias("differ"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_half_open(spark, d):
    return range_scan(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 900)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey LIMIT 64")
def range_page(spark, d):
    return range_scan(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 900).orderBy("o_orderkey").limit(64)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def projection_writable(spark, d):
    return keyset.writable(table(spark, d, "customer"), {"c_mktsegment", "c_nationkey"})


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def two_phase_payload(spark, d):
    docs = table(spark, d, "documents")
    return keyset.payload_of_keys(docs.select("doc_id", "source", "n_chars"), docs.where("lang = 'en'"), "doc_id")


# ---------------------------------------------------------------- chunk plans

_RANGES = "SELECT i, lo + (hi - lo + 1) * (i + 1) // 7 - 1 AS e FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), range(7) AS r(i)"
_PLAN = f"SELECT cast(i AS BIGINT) AS chunk_id, cast(lag(e) OVER (ORDER BY i) AS BIGINT) AS start_key, cast(CASE WHEN i < 6 THEN e END AS BIGINT) AS end_key FROM ({_RANGES})"


@query("SELECT cast(min(o_orderkey) AS BIGINT) AS min_key, cast(max(o_orderkey) AS BIGINT) AS max_key, cast(coalesce(min(o_orderkey), 0) AS BIGINT) AS min_or_0, cast(coalesce(max(o_orderkey), -1) AS BIGINT) AS max_or_minus_1 FROM orders")
def chunk_minmax(spark, d):
    return chunks.extent(table(spark, d, "orders"), "o_orderkey")


@query(_PLAN)
def chunk_int_range(spark, d):
    return chunks.int_range(table(spark, d, "orders"), "o_orderkey", 7)


@query("SELECT i AS chunk_id, CASE WHEN i > 0 THEN lo + i * step END AS start_key, CASE WHEN i < 4 THEN lo + (i + 1) * step END AS end_key FROM (SELECT min(o_orderkey) AS lo, cast(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 5.0) AS BIGINT) AS step FROM orders), range(5) AS r(i)")
def chunk_legacy_split(spark, d):
    return chunks.equal_split(table(spark, d, "orders"), "o_orderkey", 5)


@query("SELECT cast(rn // 1000 AS BIGINT) AS boundary, o_orderkey AS key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn % 1000 = 0 AND rn <= 1000 * 32")
def chunk_nth_row(spark, d):
    return chunks.nth_row(table(spark, d, "orders"), "o_orderkey", 1000, 32)


@query("SELECT key, text FROM (SELECT rn, key, text, max(text) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_orderkey AS key, cast(o_orderkey AS VARCHAR) AS text FROM orders) WHERE rn % 700 = 0 AND rn <= 700 * 15) WHERE top IS NULL OR text > top")
def chunk_legacy_step(spark, d):
    return chunks.legacy_steps(table(spark, d, "orders"), "o_orderkey", 700, 16)


@query("SELECT max(doc_id) - min(doc_id) + 1 AS span, cast(80 AS BIGINT) AS estimated_rows, CASE WHEN max(doc_id) - min(doc_id) + 1 > 4 * 80 THEN 'keyset' ELSE 'range' END AS plan FROM labels")
def chunk_sparse_choice(spark, d):
    return chunks.strategy(table(spark, d, "labels"), "doc_id", 80)


@query(f"SELECT chunk_id, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders JOIN ({_PLAN}) ON (start_key IS NULL OR o_orderkey > start_key) AND (end_key IS NULL OR o_orderkey <= end_key) GROUP BY chunk_id")
def chunk_assignment(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return chunks.assigned(orders, "o_orderkey", chunks.int_range(orders, "o_orderkey", 7)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT count(*) AS table_rows, count(*) AS chunk_rows, count(*) AS distinct_rows FROM orders")
def chunk_coverage_check(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    inside = chunks.assigned(orders, "o_orderkey", chunks.int_range(orders, "o_orderkey", 7)).agg(F.count("*").alias("chunk_rows"), F.countDistinct("o_orderkey").alias("distinct_rows"))
    return orders.agg(F.count("*").alias("table_rows")).join(F.broadcast(inside))


_CHUNK_QUEUE = values("table_name, chunk_id", "'a', 0", "'a', 1", "'a', 2", "'b', 0", "'c', 0", "'c', 1")


@query(f"SELECT table_name, chunk_id, row_number() OVER (PARTITION BY table_name ORDER BY chunk_id) AS turn FROM ({_CHUNK_QUEUE})")
def chunk_fair_order(spark, d):
    return chunks.fair_order(spark.sql(_CHUNK_QUEUE))


# ---------------------------------------------------------------- catalog

_COLUMNS = values(
    "table_name, column_name, ordinal, data_type, is_nullable, auto_increment, extra",
    "'orders', 'id', 1, 'bigint(20)', 'NO', true, 'auto_increment'", "'orders', 'tenant_id', 2, 'int', 'NO', false, ''", "'orders', 'amount', 3, 'decimal', 'YES', false, ''",
    "'users', 'email', 1, 'varchar', 'NO', false, ''", "'users', 'phone', 2, 'varchar', 'YES', false, ''", "'users', 'name', 3, 'text', 'YES', false, ''", "'users', 'nick', 4, 'int unsigned', 'NO', false, 'VIRTUAL GENERATED'",
    "'logs', 'message', 1, 'longtext', 'YES', false, ''", "'logs', 'level', 2, 'tinytext', 'YES', false, 'STORED GENERATED'",
    "'pairs', 'a', 1, 'mediumint zerofill', 'NO', false, ''", "'pairs', 'b', 2, 'json', 'NO', false, 'DEFAULT_GENERATED'",
)
_INDEXES = values(
    "table_name, index_name, non_unique, seq, column_name",
    "'orders', 'PRIMARY', 0, 1, 'id'", "'orders', 'PRIMARY', 0, 2, 'tenant_id'", "'orders', 'uk_x', 0, 1, 'tenant_id'",
    "'users', 'a_phone', 0, 1, 'phone'", "'users', 'b_expr', 0, 1, cast(null as varchar(9))", "'users', 'c_email', 0, 1, 'email'", "'users', 'd_nick', 0, 1, 'nick'", "'users', 'k_name', 1, 1, 'name'",
    "'pairs', 'uk_ab', 0, 2, 'b'", "'pairs', 'uk_ab', 0, 1, 'a'",
)
_IDENTITY = f"""WITH c AS ({_COLUMNS}), i AS ({_INDEXES}),
e AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols, max(column_name) FILTER (WHERE auto_increment) AS auto_col FROM c GROUP BY table_name),
p AS (SELECT table_name, string_agg(column_name, ',' ORDER BY seq) AS cols FROM i WHERE index_name = 'PRIMARY' GROUP BY table_name),
u AS (SELECT i.table_name, index_name, string_agg(i.column_name, ',' ORDER BY seq) AS cols, bool_or(i.column_name IS NULL OR coalesce(is_nullable = 'YES', true)) AS bad
 FROM i LEFT JOIN c ON c.table_name = i.table_name AND c.column_name = i.column_name WHERE non_unique = 0 AND index_name <> 'PRIMARY' GROUP BY 1, 2),
f AS (SELECT table_name, arg_min(cols, index_name) AS cols FROM u WHERE NOT bad GROUP BY table_name),
s AS (SELECT e.table_name, CASE WHEN p.cols IS NOT NULL THEN 'PK_STRATEGY' WHEN f.cols IS NOT NULL THEN 'UK_STRATEGY' ELSE 'FULL_COLUMNS_STRATEGY' END AS strategy, coalesce(p.cols, f.cols, e.cols) AS identify_cols, auto_col
 FROM e LEFT JOIN p USING (table_name) LEFT JOIN f USING (table_name))
SELECT table_name, strategy, identify_cols, CASE WHEN strategy <> 'FULL_COLUMNS_STRATEGY' AND contains(identify_cols, ',') AND list_contains(string_split(identify_cols, ','), auto_col) THEN auto_col ELSE identify_cols END AS cursor_cols FROM s"""


def _identities(spark):
    return catalog.identities(spark.sql(_COLUMNS), spark.sql(_INDEXES))


@query(f"SELECT table_name, strategy, identify_cols FROM ({_IDENTITY})")
def identity_strategy(spark, d):
    return _identities(spark).select("table_name", "strategy", "identify_cols")


@query(f"SELECT table_name, cursor_cols FROM ({_IDENTITY})")
def cursor_cols(spark, d):
    return _identities(spark).select("table_name", "cursor_cols")


@query(f"SELECT column_name, table_name, CASE WHEN contains(lower(extra), 'virtual generated') THEN 'VIRTUAL' WHEN contains(lower(extra), 'stored generated') THEN 'STORED' ELSE '' END AS kind FROM ({_COLUMNS})")
def generated_kind(spark, d):
    return spark.sql(_COLUMNS).select("column_name", "table_name", catalog.generated_kind(F.col("extra")).alias("kind"))


@query(f"SELECT table_name, column_name, data_type IN ('bigint(20)', 'int', 'mediumint zerofill') AS is_int FROM ({_COLUMNS})")
def int_column_class(spark, d):
    return spark.sql(_COLUMNS).select("table_name", "column_name", catalog.is_int_type(F.col("data_type")).alias("is_int"))


_TYPES = values("data_type", "'text(100)'", "'LONGTEXT '", "'blob unsigned'", "'json zerofill unsigned'", "'text unsigned zerofill'", "'tinytext'", "'varchar(20)'", "'MediumBlob(9) x'", "'textual'")


@query(f"SELECT data_type, trim(regexp_replace(regexp_replace(split_part(lower(trim(data_type)), '(', 1), ' unsigned$', ''), ' zerofill$', '')) IN ('json', 'text', 'mediumtext', 'longtext', 'blob', 'tinyblob', 'mediumblob', 'longblob') AS is_wide FROM (SELECT data_type FROM ({_COLUMNS}) UNION ALL {_TYPES})")
def wide_column_class(spark, d):
    return spark.sql(_COLUMNS).select("data_type").unionByName(spark.sql(_TYPES)).select("data_type", catalog.is_wide_type(F.col("data_type")).alias("is_wide"))


_TASK_DBS = values("task_id, sources_text, targets_text, target_schema", "'t1', 'a,b', 'x, ', ''", "'t2', 'a', '', 'z'", "'t3', 'a', 'q', 'z'", "'t4', 'a,b,c', 'u', 'w'")


@query(f"""SELECT task_id, cast(i AS BIGINT) AS i, s[i + 1] AS source, coalesce(nullif(trim(t[i + 1]), ''), CASE WHEN len(s) = 1 THEN nullif(trim(target_schema), '') END, s[i + 1]) AS target
FROM (SELECT task_id, string_split(sources_text, ',') AS s, string_split(targets_text, ',') AS t, target_schema, unnest(range(len(string_split(sources_text, ',')))) AS i FROM ({_TASK_DBS}))""")
def db_mapping(spark, d):
    df = spark.sql(_TASK_DBS).withColumns({"sources": F.split("sources_text", ","), "targets": F.split("targets_text", ",")})
    return catalog.database_pairs(df)


_NAMES = values("name", "'shop.orders'", "'users'", "'a.b.c'", "'.x'")


@query(f"SELECT name, CASE WHEN contains(name, '.') THEN string_split(name, '.')[1] ELSE 'main' END AS schema_name, CASE WHEN contains(name, '.') THEN substr(name, instr(name, '.') + 1) ELSE name END AS table_name FROM ({_NAMES})")
def qualified_names(spark, d):
    schema, name = catalog.split_name(F.col("name"), F.lit("main"))
    return spark.sql(_NAMES).select("name", schema.alias("schema_name"), name.alias("table_name"))


_RENAMES = values("source_table, target_table", "'events', 'events_copy'", "'orders', 'orders_2024'")


@query(f"WITH n AS (SELECT unnest(['events', 'orders', 'part']) AS source_table), r AS ({_RENAMES}) SELECT n.source_table, coalesce(r.target_table, n.source_table) AS target_table FROM n LEFT JOIN r USING (source_table)")
def table_rename(spark, d):
    names = spark.sql("SELECT explode(array('events', 'orders', 'part')) AS source_table")
    return names.join(F.broadcast(spark.sql(_RENAMES)), "source_table", "left").select("source_table", F.coalesce("target_table", "source_table").alias("target_table"))


_SEEN = values("schema_name, table_name", "'shop', 'orders'", "'shop', 'users'", "'crm', 'users'", "'crm.x', 'users'", "'log', 'any'")


@query(f"SELECT schema_name, table_name FROM ({_SEEN}) WHERE (schema_name = 'shop' AND table_name = 'orders') OR schema_name = 'log'")
def table_filter(spark, d):
    return spark.sql(_SEEN).where(catalog.matches_tables(F.col("schema_name"), F.col("table_name"), [("shop", "orders"), ("log", "")]))


# ---------------------------------------------------------------- reconciliation

_TARGET = """(SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 23 = 0 THEN 1.0 ELSE 0.0 END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 0
UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) + 1, o_totalprice FROM orders WHERE o_orderkey < 5)"""
_DETAIL = f"""SELECT table_name, source_rows, target_rows, target_rows - source_rows AS difference, target_rows = source_rows AS matched FROM (
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM {_TARGET}) AS target_rows
UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation)
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey > 2)
UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), NULL)"""
_SUMMARY = f"""SELECT count(*) AS checked, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS mismatched, count(*) FILTER (WHERE matched IS NULL) AS failed,
cast(coalesce(sum(source_rows) FILTER (WHERE matched IS NOT NULL), 0) AS BIGINT) AS source_total, cast(coalesce(sum(target_rows) FILTER (WHERE matched IS NOT NULL), 0) AS BIGINT) AS target_total,
cast(coalesce(sum(source_rows), 0) AS BIGINT) AS source_available, cast(coalesce(sum(target_rows), 0) AS BIGINT) AS target_available FROM ({_DETAIL})"""


def _detail(spark, d):
    orders, nation, customer, labels = (table(spark, d, t) for t in ("orders", "nation", "customer", "labels"))
    source = report.counts({"orders": orders, "nation": nation, "customer": customer, "labels": labels}, "source_rows")
    return report.detail(source, report.counts({"orders": drifted_target(orders), "nation": nation, "customer": customer.where("c_custkey > 2")}, "target_rows"))


@query(_DETAIL)
def row_count_detail(spark, d):
    return _detail(spark, d)


@query(_SUMMARY)
def row_count_summary(spark, d):
    return report.summary(_detail(spark, d))


@query(f"SELECT *, CASE WHEN matched + mismatched = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' WHEN mismatched > 0 THEN 'MISMATCHED' ELSE 'MATCHED' END AS status FROM ({_SUMMARY})")
def row_count_status(spark, d):
    return report.status(report.summary(_detail(spark, d)))


_PROGRESS = values("table_name, processed, total, elapsed", "'a', 50, 200, 10", "'b', 300, 200, 20", "'c', 0, 100, 0", "'d', 0, 0, 5")


@query(f"""SELECT table_name, least(share, 100.0) AS table_percent, share AS task_percent, speed, CASE WHEN speed > 0 AND total > processed THEN (total - processed) / speed WHEN total > 0 AND processed >= total THEN 0.0 ELSE -1.0 END AS seconds_left
FROM (SELECT *, CASE WHEN total > 0 THEN cast(processed AS DOUBLE) * 100 / total ELSE 0.0 END AS share, CASE WHEN elapsed > 0 THEN cast(processed AS DOUBLE) / elapsed ELSE 0.0 END AS speed FROM ({_PROGRESS}))""")
def table_progress(spark, d):
    df = spark.sql(_PROGRESS).withColumns({c: F.col(c).cast("double") for c in ("processed", "total", "elapsed")})
    p = lambda capped: report.progress(F.col("processed"), F.col("total"), F.col("elapsed"), capped)
    share, speed, left = p(False)
    return df.select("table_name", p(True)[0].cast("double").alias("table_percent"), share.cast("double").alias("task_percent"), speed.cast("double").alias("speed"), left.cast("double").alias("seconds_left"))


@query("SELECT source, count(*) AS n_rows, cast(sum(n_chars) AS BIGINT) AS n_bytes, count(DISTINCT doc_id // 100) AS batches FROM documents GROUP BY source")
def commit_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_bytes"), F.countDistinct(F.floor(F.col("doc_id") / 100)).alias("batches"))


_TASKS = values(
    "id, name, status, created_at, progress, source_schema, target_schema, tables_text, scheduled_at",
    "'t1', 'Orders copy', 'RUNNING', 10, 42.5, 'shop', 'dw', 'orders,items', 0", "'t2', 'users', 'PENDING', 20, 0.0, 'crm', 'dw', 'users', 0", "'t3', 'Billing', 'FAILED', 30, 99.0, 'fin', 'fin2', 'invoices', 0",
    "'t4', 'archive', 'SCHEDULED', 40, 0.0, 'shop', 'cold', 'orders', 50", "'t5', 'zeta', 'SCHEDULED', 50, 0.0, 'shop', 'cold', 'parts', 90", "'t6', 'alpha', 'COMPLETED', 60, 100.0, 'x', 'y', 'z', 0", "'t7', 'Orders old', 'STOPPED', 70, 12.0, 'shop', 'dw', 'old', 0", "'t8', 'pause', 'PAUSED', 70, 12.0, 'a', 'b', 'my_orders', 0",
)


def _tasks(spark):
    return spark.sql(_TASKS).withColumn("tables", F.split("tables_text", ","))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM ({_TASKS})")
def task_state_counts(spark, d):
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return _tasks(spark).agg(F.count("*").alias("total"), n("RUNNING"), n("COMPLETED"), n("FAILED"))


_MANIFEST = values("task_id, table_name, phase, attempt, expected", "'m1', 'a', 'PUBLISHED', 1, 2", "'m1', 'b', 'PUBLISHED', 2, 2", "'m2', 'a', 'COPYING', 1, 2", "'m2', 'b', 'PUBLISHED', 1, 2", "'m3', 'a', 'PUBLISHED', 1, 2")


@query(f"SELECT task_id, bool_and(phase = 'PUBLISHED') AND count(*) >= max(expected) AS complete FROM ({_MANIFEST}) GROUP BY task_id")
def manifest_complete(spark, d):
    return spark.sql(_MANIFEST).groupBy("task_id").agg((F.bool_and(F.col("phase") == "PUBLISHED") & (F.count("*") >= F.max("expected"))).alias("complete"))


@query(f"SELECT task_id, table_name, phase FROM ({_MANIFEST}) WHERE phase <> 'PUBLISHED'")
def resume_pending_tables(spark, d):
    return spark.sql(_MANIFEST).where("phase <> 'PUBLISHED'").select("task_id", "table_name", "phase")


_SENT_BATCHES = values("task_id, table_name, attempt, batch", "'m1', 'b', 1, 0", "'m1', 'b', 2, 0", "'m1', 'b', 2, 1", "'m1', 'a', 1, 0", "'m3', 'a', 0, 0")


@query(f"SELECT b.task_id, b.table_name, b.attempt, b.batch FROM ({_SENT_BATCHES}) b JOIN ({_MANIFEST}) m USING (task_id, table_name, attempt)")
def current_attempt_batches(spark, d):
    now = spark.sql(_MANIFEST).select("task_id", "table_name", "attempt")
    return spark.sql(_SENT_BATCHES).join(F.broadcast(now), ["task_id", "table_name", "attempt"], "left_semi").select("task_id", "table_name", "attempt", "batch")


# ---------------------------------------------------------------- change log

_LOG = """(SELECT event_id, event_id // 7 AS txn, 'mysql-bin.' || lpad(cast(event_id // 7 // 143 + 1 AS VARCHAR), 6, '0') AS file, 4 + (event_id % 1001) * 64 AS pos,
max(4 + (event_id % 1001) * 64) OVER (PARTITION BY event_id // 7) AS commit_pos, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, user_id AS old_key,
CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 11 = 0 THEN (user_id + 1) % (SELECT max(user_id) + 1 FROM events) ELSE user_id END AS new_key, event_type, value FROM events)"""


def _log(spark, d):
    return change_log(table(spark, d, "events"))


_FILES = values("file, pos", "'mysql-bin.999999', 4", "'mysql-bin.1000000', 4", "'mysql-bin.1000000', 120", "'plain', 9", "'mysql-bin.000002', 77")


@query(f"SELECT file, cast(pos AS BIGINT) AS pos, row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(file, '([0-9]+)$', 1), '') AS BIGINT) NULLS FIRST, file, pos) AS place FROM ({_FILES})")
def position_order(spark, d):
    from pyspark.sql import Window

    return spark.sql(_FILES).select("file", F.col("pos").cast("long").alias("pos"), F.row_number().over(Window.orderBy(changelog.position(F.col("file"), F.col("pos")))).cast("long").alias("place"))


_POSITIONS = values("said", "'mysql-bin.000001:120'", "'a:b:44'", "'mysql-bin.000001:3'", "':77'", "'nothing'")


@query(f"SELECT said, CASE WHEN ok THEN regexp_extract(said, '^(.+):([0-9]+)$', 1) END AS file, CASE WHEN ok THEN cast(regexp_extract(said, '^(.+):([0-9]+)$', 2) AS BIGINT) END AS pos FROM (SELECT said, regexp_extract(said, '^(.+):([0-9]+)$', 1) <> '' AND try_cast(nullif(regexp_extract(said, '^(.+):([0-9]+)$', 2), '') AS BIGINT) >= 4 AS ok FROM ({_POSITIONS}))")
def position_parse(spark, d):
    return spark.sql(_POSITIONS).select("said", changelog.parse_position(F.col("said")).alias("p")).select("said", "p.file", "p.pos")


_LAGS = values("sink, file, pos, master_file, master_pos", "'a', 'b.1', 100, 'b.1', 700", "'b', 'b.1', 900, 'b.1', 700", "'c', 'b.1', 100, 'b.2', 4")


@query(f"SELECT sink, cast(CASE WHEN file = master_file THEN cast(greatest(master_pos - pos, 0) AS VARCHAR) ELSE '18446744073709551615' END AS VARCHAR) AS behind FROM ({_LAGS})")
def lag(spark, d):
    return spark.sql(_LAGS).select("sink", changelog.lag_bytes(F.col("file"), F.col("pos"), F.col("master_file"), F.col("master_pos")).cast("string").alias("behind"))


@query(f"""SELECT txn, op, event_id % 7 AS row_index, CASE WHEN op <> 'INSERT' THEN old_key END AS before, CASE WHEN op <> 'DELETE' THEN new_key END AS after FROM {_LOG} WHERE op = 'UPDATE'
UNION ALL SELECT txn, op, event_id % 7, CASE WHEN op = 'DELETE' THEN old_key END, CASE WHEN op = 'INSERT' THEN old_key END FROM {_LOG} WHERE op <> 'UPDATE'""")
def explode_rows(spark, d):
    log = _log(spark, d)
    images = F.when(F.col("op") == "UPDATE", F.array("old_key", "new_key")).otherwise(F.array("old_key"))
    rows = changelog.exploded(log.select((F.col("event_id") % 7).alias("at"), "txn", "op", images.alias("images")).withColumn("txn", F.struct("txn", "at")))
    return rows.select("txn.txn", "op", (F.col("txn.at") + F.col("row_index")).alias("row_index"), "before", "after")


_NORMAL = f"""SELECT event_id, 'task_001' AS task_id, op AS event_type, file AS binlog_file, commit_pos AS binlog_pos, CASE WHEN op = 'DELETE' THEN old_key ELSE new_key END AS key,
CASE WHEN op <> 'INSERT' THEN old_key END AS before_key, CASE WHEN op <> 'DELETE' THEN new_key END AS after_key FROM {_LOG}"""


@query(_NORMAL)
def normalize_events(spark, d):
    return changelog.normalised(_log(spark, d), "task_001", "mydb", "users").select("event_id", "task_id", "event_type", "binlog_file", "binlog_pos", "key", F.col("before.user_id").alias("before_key"), F.col("after.user_id").alias("after_key"))


@query(f"SELECT event_id, 'task_001:' || file || ':' || commit_pos || ':0' AS trace_id, 'task_001:' || file || ':' || commit_pos || ':' || (row_number() OVER (PARTITION BY txn ORDER BY event_id) - 1) AS event_uid FROM {_LOG}")
def trace_ids(spark, d):
    return changelog.normalised(_log(spark, d), "task_001", "mydb", "users").select("event_id", "trace_id", "event_uid")


@query(f"SELECT DISTINCT txn, file, commit_pos, count(*) OVER (PARTITION BY txn) AS n_rows FROM {_LOG}")
def txn_commit_positions(spark, d):
    return _log(spark, d).groupBy("txn", "file", "commit_pos").agg(F.count("*").alias("n_rows"))


@query(f"""WITH p AS (SELECT * FROM {_LOG} WHERE (file, commit_pos) > ('mysql-bin.000001', 4000)), s AS (SELECT min((file, commit_pos)) AS stop FROM p WHERE (file, commit_pos) >= ('mysql-bin.000001', 20000))
SELECT event_id, txn FROM p, s WHERE stop IS NULL OR (file, commit_pos) <= stop""")
def bounded_catchup(spark, d):
    return changelog.bounded(_log(spark, d), ("mysql-bin.000001", 4000), ("mysql-bin.000001", 20000)).select("event_id", "txn")


_MARKS = values("sink, mark_file, mark_pos", "'a', 'mysql-bin.000001', 30000", "'b', cast(null as varchar(20)), cast(null as bigint)")


@query(f"SELECT sink, event_id FROM {_LOG} l, ({_MARKS}) m WHERE mark_file IS NULL OR (file, commit_pos) > (mark_file, mark_pos)")
def skip_applied(spark, d):
    return changelog.unapplied(_log(spark, d), spark.sql(_MARKS)).select("sink", "event_id")


@query(f"SELECT sink, op, count(*) AS n FROM {_LOG} l, ({_MARKS}) m WHERE mark_file IS NULL OR (file, commit_pos) > (mark_file, mark_pos) GROUP BY sink, op")
def sink_fanout(spark, d):
    return changelog.unapplied(_log(spark, d), spark.sql(_MARKS)).groupBy("sink", "op").agg(F.count("*").alias("n"))


@query("SELECT c_name, CASE WHEN h = 0 THEN 1 ELSE h END AS server_id FROM (SELECT c_name, cast(list_reduce(list_prepend(cast(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: cast(unicode(x) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS BIGINT) AS h FROM customer)")
def server_id(spark, d):
    return table(spark, d, "customer").select("c_name", changelog.server_id(F.col("c_name")).alias("server_id"))


# ---------------------------------------------------------------- replay

_OPS = f"""(SELECT old_key AS key, event_id AS ord, 0 AS sub, CASE WHEN op = 'UPDATE' AND old_key <> new_key THEN 'DELETE' ELSE op END AS op, value FROM {_LOG}
UNION ALL SELECT new_key, event_id, 1, 'INSERT', value FROM {_LOG} WHERE op = 'UPDATE' AND old_key <> new_key)"""
_BASE = "SELECT c_custkey AS key, -1 AS ord, 0 AS sub, 'INSERT' AS op, c_acctbal AS value FROM customer"
_KEYED = """SELECT key, arg_max(value, ord * 2 + sub) FILTER (WHERE op <> 'DELETE') AS value FROM {ops} GROUP BY key HAVING arg_max(op, ord * 2 + sub) FILTER (WHERE op <> 'UPDATE') = 'INSERT'"""
_ALL_OPS = f"({_OPS[1:-1]} UNION ALL {_BASE})"
_UNMATCHED = f"""SELECT key, ord, sub, op FROM (SELECT *, last_value(CASE WHEN op <> 'UPDATE' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ord, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {_OPS}) WHERE op <> 'INSERT' AND (last IS NULL OR last = 'DELETE')"""


def _ops(spark, d, based=True):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return replay.operations(_log(spark, d), base if based else None)


@query(_KEYED.format(ops=_ALL_OPS))
def replay_keyed(spark, d):
    return replay.keyed(_ops(spark, d))


@query(f"SELECT key, ord, sub, op FROM {_OPS} WHERE (ord) IN (SELECT event_id FROM {_LOG} WHERE op = 'UPDATE' AND old_key <> new_key)")
def replay_key_change(spark, d):
    return replay.operations(_log(spark, d).where("op = 'UPDATE' and old_key <> new_key")).select("key", "ord", F.col("sub").alias("sub"), "op")


@query(f"SELECT old_key AS key, arg_max_null(CASE WHEN event_id % 5 <> 1 THEN value END, event_id) FILTER (WHERE event_id % 3 <> 0) AS value, arg_max_null(event_type, event_id) FILTER (WHERE event_id % 2 = 0) AS event_type FROM {_LOG} WHERE op = 'UPDATE' GROUP BY old_key")
def replay_partial_image(spark, d):
    has = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    present = F.concat(has(F.col("event_id") % 3 != 0, "value"), has(F.col("event_id") % 2 == 0, "event_type"))
    log = _log(spark, d).where("op = 'UPDATE'").select("event_id", F.col("old_key").alias("key"), F.when(F.col("event_id") % 5 != 1, F.col("value")).alias("value"), "event_type", present.alias("present"))
    return replay.latest_fields(log, "key", ["value", "event_type"])


@query(f"SELECT key, ord, sub FROM ({_UNMATCHED}) WHERE op = 'UPDATE'")
def zero_row_updates(spark, d):
    return replay.unmatched(_ops(spark, d, False)).where("op = 'UPDATE'").select("key", "ord", "sub")


@query(f"SELECT key, ord, sub FROM ({_UNMATCHED}) WHERE op = 'DELETE'")
def zero_row_deletes(spark, d):
    return replay.unmatched(_ops(spark, d, False)).where("op = 'DELETE'").select("key", "ord", "sub")


_BAG = """(SELECT user_id, event_type, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS d FROM events
UNION ALL SELECT user_id, event_type, -1, count(*) FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2)"""


@query(f"SELECT user_id, event_type, cast(n AS BIGINT) AS n FROM (SELECT user_id, event_type, arg_max(s, ord) - least(0, min(s)) AS n FROM (SELECT *, sum(d) OVER (PARTITION BY user_id, event_type ORDER BY ord) AS s FROM {_BAG}) GROUP BY 1, 2) WHERE n > 0")
def replay_bag_insert_delete(spark, d):
    events = table(spark, d, "events")
    log = events.select("user_id", "event_type", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, "INSERT").otherwise("DELETE").alias("op"))
    return replay.bag(log, events.where("event_id % 5 = 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])


_TARGET_ROWS = "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0"
_BATCH_ROWS = "SELECT user_id AS key, 'user ' || event_id AS name, event_id AS ord FROM events WHERE event_type = 'signup'"


def _batch(spark, d):
    target = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    batch = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.concat(F.lit("user "), F.col("event_id")).alias("name"), F.col("event_id").alias("ord"))
    return target, batch


@query(f"WITH b AS (SELECT key, arg_max(name, ord) AS name FROM ({_BATCH_ROWS}) GROUP BY key) SELECT key, name FROM b UNION ALL SELECT key, name FROM ({_TARGET_ROWS}) t WHERE key NOT IN (SELECT key FROM b)")
def upsert_batch(spark, d):
    return replay.upserted(*_batch(spark, d), "key")


@query(f"WITH t AS ({_TARGET_ROWS}), b AS (SELECT key, arg_min(name, ord) AS name FROM ({_BATCH_ROWS}) GROUP BY key) SELECT * FROM t UNION ALL SELECT key, name FROM b WHERE key NOT IN (SELECT key FROM t)")
def insert_ignore_batch(spark, d):
    return replay.ignored(*_batch(spark, d), "key")


@query(f"SELECT event_id, old_key <> new_key AS changed FROM {_LOG} WHERE op = 'UPDATE'")
def identity_changed(spark, d):
    return _log(spark, d).where("op = 'UPDATE'").select("event_id", (~F.col("old_key").cast("string").eqNullSafe(F.col("new_key").cast("string"))).alias("changed"))


@query(f"""SELECT o_orderkey, source_value, target_value, kind FROM (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.o_totalprice AS source_value, t.o_totalprice AS target_value,
CASE WHEN t.o_totalprice IS NULL THEN 'missing' WHEN s.o_totalprice IS NULL THEN 'extra' WHEN s.o_totalprice <> t.o_totalprice THEN 'different' END AS kind FROM orders s FULL JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey) WHERE kind IS NOT NULL""")
def drift_detect(spark, d):
    orders = table(spark, d, "orders")
    return replay.drift(orders, drifted_target(orders), "o_orderkey", "o_totalprice")


@query(_KEYED.format(ops=_OPS))
def stream_replay(spark, d):
    return apply.replayed(spark, _log(spark, d))


# ---------------------------------------------------------------- sinks

_KEY = "CASE WHEN op = 'DELETE' THEN old_key ELSE new_key END"
_MESSAGE = f"""'{{"task_id":"task_001","source_schema":"mydb","source_table":"users","event_type":"' || op || '","event_time":"' || strftime(TIMESTAMP '2024-01-01' + to_seconds(event_id), '%Y-%m-%dT%H:%M:%S') || 'Z","binlog_file":"' || file || '","binlog_pos":' || commit_pos || ',"primary_keys":{{"user_id":' || {_KEY} || '}}'
|| CASE WHEN op <> 'INSERT' THEN ',"before":{{"event_type":"' || event_type || '","user_id":' || old_key || '}}' ELSE '' END || CASE WHEN op <> 'DELETE' THEN ',"after":{{"event_type":"' || event_type || '","user_id":' || new_key || '}}' ELSE '' END || ',"trace_id":"task_001:' || file || ':' || commit_pos || ':0"}}'"""


def _wired(spark, d):
    """Change events in the columns of changelog.wire."""
    rows = changelog.normalised(_log(spark, d), "task_001", "mydb", "users")
    image = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.user_id").alias("user_id"), F.col(f"{c}.event_type").alias("event_type"))).alias(c)
    time = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("event_id"))
    return rows.select("event_id", "task_id", "source_schema", "source_table", "event_type", time.alias("event_time"), "binlog_file", "binlog_pos", F.struct(F.col("key").alias("user_id")).alias("primary_keys"), image("before"), image("after"), "trace_id")


def _messages(spark, d, mode="per_table", keys="primary"):
    events = _wired(spark, d)
    return events.select("event_id", changelog.message_topic(mode, "all_changes", "cdc").alias("topic"), changelog.message_key(events, keys).alias("key"), changelog.wire(events).alias("value"))


@query(f"SELECT event_id, 'cdc.mydb.users' AS topic, cast({_KEY} AS VARCHAR) AS key, {_MESSAGE} AS value FROM {_LOG}")
def kafka_messages(spark, d):
    return _messages(spark, d)


@query(f"SELECT event_id, 'all_changes' AS topic, 'mydb.users:' || commit_pos AS key FROM {_LOG}")
def kafka_messages_without_keys(spark, d):
    return _messages(spark, d, "single", "none").select("event_id", "topic", "key")


@query("SELECT event_id, user_id || ':' || event_type AS key FROM events")
def kafka_composite_key(spark, d):
    events = table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("z_type"), F.col("user_id").alias("a_user")).alias("primary_keys"))
    return events.select("event_id", changelog.message_key(events, "primary").alias("key"))


@query("SELECT 'cdc.mydb.users' AS topic, count(*) AS n FROM events HAVING count(*) > 0")
def kafka_topic_counts(spark, d):
    return _messages(spark, d).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, 'POST' AS method, 'application/json' AS content_type, 'task_001:' || file || ':' || commit_pos || ':0' AS idempotency_key, {_MESSAGE} AS body FROM {_LOG}")
def webhook_requests(spark, d):
    events = _wired(spark, d)
    return events.select("event_id", F.lit("POST").alias("method"), F.lit("application/json").alias("content_type"), F.col("trace_id").alias("idempotency_key"), changelog.wire(events).alias("body"))


@query("SELECT l_orderkey // 1000 AS part, cast(ceil(count(*) / 50.0) AS BIGINT) AS statements FROM lineitem GROUP BY 1")
def statement_split_rows(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 1000).alias("part")).agg(F.ceil(F.count("*") / 50).cast("long").alias("statements"))


def _fold_sql(rows_sql: str, cut: str) -> str:
    return f"""WITH RECURSIVE r AS (SELECT g, k, s, row_number() OVER (PARTITION BY g ORDER BY k) AS rn FROM ({rows_sql})),
f AS (SELECT g, k, s, rn, cast(0 AS BIGINT) AS batch, cast(1 AS BIGINT) AS n, cast(s AS BIGINT) AS held, cast(s AS BIGINT) AS first FROM r WHERE rn = 1
UNION ALL SELECT r.g, r.k, r.s, r.rn, f.batch + CASE WHEN {cut} THEN 1 ELSE 0 END, CASE WHEN {cut} THEN 1 ELSE f.n + 1 END, CASE WHEN {cut} THEN r.s ELSE f.held + r.s END, CASE WHEN {cut} THEN r.s ELSE f.first END
FROM f JOIN r ON r.g = f.g AND r.rn = f.rn + 1)"""


_DOC_ROWS = "SELECT source AS g, doc_id AS k, n_chars AS s FROM documents"
_TXN_ROWS = "SELECT cast(user_id % 10 AS VARCHAR) AS g, event_id AS k, length(props) AS s FROM events"


@query(_fold_sql(_DOC_ROWS, "(f.n >= 8 OR f.held >= 9000)") + " SELECT g AS source, k AS doc_id, s AS n_chars, batch FROM f")
def batch_cut_bytes(spark, d):
    return batching.reader_batches(table(spark, d, "documents"), "source", "doc_id", "n_chars", 8, 9000)


@query(_fold_sql(_DOC_ROWS, "(f.n >= 8 OR f.held + r.s > 9000)") + " SELECT g AS source, k AS doc_id, s AS n_chars, batch FROM f")
def statement_split_bytes(spark, d):
    return batching.writer_statements(table(spark, d, "documents"), "source", "doc_id", "n_chars", 8, 9000)


@query(_fold_sql(_TXN_ROWS, "(f.n >= 40 OR f.held >= 350)") + " SELECT g AS table_name, batch AS txn, count(*) AS n_rows, cast(sum(s) AS BIGINT) AS n_bytes FROM f GROUP BY 1, 2")
def txn_grouping(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("table_name"), "event_id", F.length("props").cast("long").alias("size"))
    return batching.reader_batches(rows, "table_name", "event_id", "size", 40, 350).groupBy("table_name", F.col("batch").alias("txn")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


# ---------------------------------------------------------------- event log

_EVENTS = """(SELECT event_id AS seq, 'task_' || (user_id % 3) AS task_id, 'exec_' || (user_id % 3) || '_' || (event_id // 100) AS execution_id, cast(floor(epoch(ts)) AS BIGINT) AS ts,
CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' THEN 'WARN' ELSE 'INFO' END AS severity, CASE WHEN event_id % 4 = 0 THEN 'KEY' ELSE 'DIAGNOSTIC' END AS visibility, event_type AS code, props AS message FROM events)"""


def _events(spark, d):
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").otherwise("INFO")
    task = F.concat(F.lit("task_"), F.col("user_id") % 3)
    execution = F.concat(F.lit("exec_"), F.col("user_id") % 3, F.lit("_"), F.floor(F.col("event_id") / 100))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), task.alias("task_id"), execution.alias("execution_id"), seconds.alias("ts"), severity.alias("severity"), F.when(F.col("event_id") % 4 == 0, "KEY").otherwise("DIAGNOSTIC").alias("visibility"), F.col("event_type").alias("code"), F.col("props").alias("message"))


@query(f"SELECT seq, execution_id, severity, code FROM {_EVENTS} WHERE task_id = 'task_1' AND seq < 900 AND seq > 100 ORDER BY seq DESC LIMIT 100")
def event_list(spark, d):
    return eventlog.listed(_events(spark, d), "task_1", before=900, after=100).select("seq", "execution_id", "severity", "code")


@query(f"SELECT task_id, execution_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM {_EVENTS} GROUP BY 1, 2")
def event_executions(spark, d):
    return eventlog.executions(_events(spark, d))


@query(f"SELECT seq, task_id, severity FROM {_EVENTS} WHERE task_id = 'task_0' AND severity IN ('WARN', 'ERROR') ORDER BY seq DESC LIMIT 500")
def event_min_severity(spark, d):
    return eventlog.listed(_events(spark, d), "task_0", least="WARN", limit=1000).select("seq", "task_id", "severity")


_PROTECTED = values("task_id, execution_id", "'task_0', 'exec_0_1'", "'task_2', 'exec_2_3'")
_OLDEST = 1704500000
_KEPT = f"""SELECT seq, task_id FROM (SELECT *, CASE WHEN ok AND visibility = 'KEY' THEN row_number() OVER (PARTITION BY task_id, ok, visibility ORDER BY seq DESC) END AS n_key, CASE WHEN ok AND severity = 'ERROR' THEN row_number() OVER (PARTITION BY task_id, ok, severity ORDER BY seq DESC) END AS n_error
FROM (SELECT e.*, p.task_id IS NOT NULL AS guard, p.task_id IS NULL AND NOT (visibility = 'KEY' AND ts < {_OLDEST}) AS ok FROM {_EVENTS} e LEFT JOIN ({_PROTECTED}) p ON p.task_id = e.task_id AND p.execution_id = e.execution_id)) WHERE guard OR n_key <= 60 OR n_error <= 25"""


def _kept(spark, d):
    return eventlog.kept(_events(spark, d), 60, 25, F.lit(_OLDEST), F.broadcast(spark.sql(_PROTECTED)))


@query(_KEPT)
def event_prune_keep(spark, d):
    return _kept(spark, d).select("seq", "task_id")


@query(f"SELECT seq, task_id FROM {_EVENTS} WHERE seq NOT IN (SELECT seq FROM ({_KEPT}))")
def event_prune_removed(spark, d):
    return eventlog.removed(_events(spark, d), _kept(spark, d)).select("seq", "task_id")


@query(f"SELECT seq, substr(sha256(task_id || '|' || execution_id || '|' || code || '|' || severity || '|' || message), 1, 32) AS fingerprint FROM {_EVENTS}")
def event_fingerprint(spark, d):
    return _events(spark, d).select("seq", eventlog.fingerprint("task_id", "execution_id", "code", "severity", "message").alias("fingerprint"))


@query(_fold_sql("SELECT event_type AS g, event_id AS k, event_id * 7 AS s FROM events", "(r.s >= f.first + 60)") + " SELECT g AS code, batch AS \"window\", min(s) AS first_s, max(s) AS last_s, count(*) AS n FROM f GROUP BY 1, 2")
def event_aggregate_60s(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("code"), "event_id", (F.col("event_id") * 7).alias("s"))
    return eventlog.windows_from_first(rows, "code", "event_id", "s", 60)


_STALL = "(SELECT user_id % 5 AS tbl, event_id AS k, event_id * 3 AS s, max(CASE WHEN event_id % 40 < 12 THEN event_id ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events)"


@query(f"""WITH a AS (SELECT *, coalesce(n > lag(n) OVER w, true) AS grew FROM {_STALL} WINDOW w AS (PARTITION BY tbl ORDER BY k)),
b AS (SELECT *, s - last_value(CASE WHEN grew THEN s END IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 60 AS stalled FROM a),
c AS (SELECT *, coalesce(lag(stalled) OVER (PARTITION BY tbl ORDER BY k), false) AS was FROM b) SELECT tbl, k, CASE WHEN stalled THEN 'NO_PROGRESS' ELSE 'RECOVERED' END AS event FROM c WHERE stalled <> was""")
def stall_detect(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("tbl").orderBy("k")
    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("tbl"), F.col("event_id").alias("k"), (F.col("event_id") * 3).alias("s"))
    rows = rows.withColumn("n", F.max(F.when(F.col("k") % 40 < 12, F.col("k")).otherwise(0)).over(own))
    return eventlog.stalls(rows, "tbl", "k", "s", "n", 60)


@query("""SELECT grp, event_id, side FROM (SELECT *, lag(side, 1, 'RECOVERED') OVER (PARTITION BY grp ORDER BY event_id) AS last FROM (SELECT user_id % 4 AS grp, event_id, CASE WHEN (event_id * 37 % 101) / 100.0 >= 0.8 THEN 'HIGH' WHEN (event_id * 37 % 101) / 100.0 < 0.5 THEN 'RECOVERED' END AS side FROM events) WHERE side IS NOT NULL) WHERE side <> last""")
def backpressure_edges(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("grp"), "event_id", ((F.col("event_id") * 37 % 101) / 100).alias("level"))
    return eventlog.edges(rows, "grp", "event_id", "level", 0.8, 0.5).select("grp", "event_id", "side")


@query(f"SELECT seq, task_id, code FROM {_EVENTS} WHERE task_id = 'task_2' AND code = 'purchase' AND ts BETWEEN 1704100000 AND 1705000000 ORDER BY seq LIMIT 40")
def audit_query(spark, d):
    rows = _events(spark, d).where("task_id = 'task_2' and code = 'purchase' and ts between 1704100000 and 1705000000")
    return rows.orderBy("seq").limit(40).select("seq", "task_id", "code")


# ---------------------------------------------------------------- tasks


@query(f"SELECT id, name FROM ({_TASKS}) WHERE upper(status) <> 'X' AND (contains(lower(name), 'order') OR contains(lower(id), 'order') OR contains(lower(source_schema), 'order') OR contains(lower(target_schema), 'order') OR contains(lower(tables_text), 'order'))")
def task_search(spark, d):
    return tasks.search(_tasks(spark), keyword="ORDER").select("id", "name")


_RANK = "CASE status WHEN 'PENDING' THEN 0 WHEN 'SCHEDULED' THEN 1 WHEN 'RUNNING' THEN 2 WHEN 'PAUSED' THEN 3 WHEN 'FAILED' THEN 4 WHEN 'COMPLETED' THEN 5 WHEN 'STOPPED' THEN 6 ELSE 7 END"


def _sort_sql(sort: str) -> str:
    kind, way = sort.split("_")
    by = {"created": "created_at", "name": "lower(name)", "status": _RANK, "progress": "progress"}[kind]
    return f"{by} {way}, id" if kind == "created" else f"{by} {way}, created_at DESC, id"


def _sorted_query(sort: str):
    from pyspark.sql import Window

    def run(spark, d):
        return _tasks(spark).select("id", F.row_number().over(Window.orderBy(*tasks.order_of(sort))).cast("long").alias("place"))

    run.__name__ = f"task_sort_{sort}"
    query(f"SELECT id, row_number() OVER (ORDER BY {_sort_sql(sort)}) AS place FROM ({_TASKS})")(run)


for _sort in tasks.SORTS:
    _sorted_query(_sort)


@query(f"SELECT id, name, status FROM ({_TASKS}) ORDER BY {_sort_sql('status_asc')} LIMIT 3 OFFSET 3")
def task_page(spark, d):
    return tasks.page(_tasks(spark), "status_asc", 2, 3).select("id", "name", "status")


@query(f"SELECT id FROM ({_TASKS}) WHERE status = 'SCHEDULED' AND scheduled_at <= 60")
def task_due(spark, d):
    return tasks.due(_tasks(spark), F.lit(60)).select("id")


@query("SELECT DISTINCT cast(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN isodow(last_day(o_orderdate)) > 5 THEN last_day(o_orderdate) - cast(isodow(last_day(o_orderdate)) - 5 AS INTEGER) ELSE last_day(o_orderdate) END AS day FROM orders")
def cron_last_business_day(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(F.trunc(day, "month").alias("month"), tasks.last_business_day(day).alias("day")).distinct()


_CONFIGS = values("id, readers, writers, batch_rows, tables, estimated_rows", "'a', 0, 3, 0, 5, 100", "'b', 40, 0, 90000, 1, 5000000", "'c', -1, 9, 500, 12, 999999", "'d', 2, 2, 1, 2, 1000000")


@query(f"SELECT id, least(CASE WHEN readers <= 0 THEN 4 ELSE readers END, 16) AS readers, least(CASE WHEN writers <= 0 THEN 4 ELSE writers END, 16) AS writers, least(CASE WHEN batch_rows <= 0 THEN 1000 ELSE batch_rows END, 10000) AS batch_rows FROM ({_CONFIGS})")
def task_config_effective(spark, d):
    option = lambda c, default, most: F.least(F.when(F.col(c) <= 0, default).otherwise(F.col(c)), F.lit(most)).alias(c)
    return spark.sql(_CONFIGS).select("id", option("readers", 4, 16), option("writers", 4, 16), option("batch_rows", 1000, 10000))


@query(f"SELECT id, CASE WHEN estimated_rows < 1000000 THEN 1 ELSE least(CASE WHEN readers <= 0 THEN 4 ELSE readers END, 16) END AS table_readers, 8 * CASE WHEN estimated_rows < 1000000 THEN 1 ELSE least(CASE WHEN readers <= 0 THEN 4 ELSE readers END, 16) END AS chunks, cast(greatest(2, ceil(tables * 0.1)) AS BIGINT) AS reserved FROM ({_CONFIGS})")
def worker_sizing(spark, d):
    readers = F.when(F.col("estimated_rows") < 1000000, 1).otherwise(F.least(F.when(F.col("readers") <= 0, 4).otherwise(F.col("readers")), F.lit(16)))
    return spark.sql(_CONFIGS).select("id", readers.alias("table_readers"), (readers * 8).alias("chunks"), F.greatest(F.lit(2), F.ceil(F.col("tables") * 0.1)).cast("long").alias("reserved"))


_WANTED = values("table_name, index_name, kind, cols", "'a', 'k1', 'BTREE', 'x,y'", "'a', 'k2', 'FULLTEXT', 'z'", "'b', 'k3', 'BTREE', 'q'", "'a', 'k4', 'BTREE', 'w'")
_THERE = values("table_name, index_name, cols", "'a', 'K1', 'X,Y'", "'b', 'k3', 'p'")


@query(f"""SELECT table_name, kind, string_agg('ADD ' || CASE WHEN kind = 'FULLTEXT' THEN 'FULLTEXT ' ELSE '' END || 'INDEX `' || index_name || '` (' || cols || ')', ', ' ORDER BY index_name) AS clauses
FROM ({_WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM ({_THERE}) t WHERE t.table_name = w.table_name AND lower(t.index_name) = lower(w.index_name) AND lower(t.cols) = lower(w.cols)) GROUP BY table_name, kind""")
def index_restore_plan(spark, d):
    low = lambda df: df.select("table_name", F.lower("index_name").alias("i"), F.lower("cols").alias("c"))
    wanted = spark.sql(_WANTED).withColumns({"i": F.lower("index_name"), "c": F.lower("cols")})
    left = wanted.join(F.broadcast(low(spark.sql(_THERE))), ["table_name", "i", "c"], "left_anti")
    clause = F.concat(F.lit("ADD "), F.when(F.col("kind") == "FULLTEXT", "FULLTEXT ").otherwise(""), F.lit("INDEX "), text.quoted(F.col("index_name")), F.lit(" ("), F.col("cols"), F.lit(")"))
    return left.groupBy("table_name", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index_name", clause.alias("clause")))), lambda x: x["clause"]), ", ").alias("clauses"))


# ---------------------------------------------------------------- scalar functions


def _redact_sql(column: str) -> str:
    steps = (
        (r"(?i)(authorization)\s*[:=]\s*Bearer\s+\S+", r"\1=Bearer [REDACTED]"),
        (r"(?i)(password|passwd|pwd|secret|token|dsn)\s*[:=]\s*[^\s,;''\"]+", r"\1=[REDACTED]"),
        (r"(?i)Bearer\s+\S+", "Bearer [REDACTED]"),
        (r"ENC~[A-Za-z0-9+/=_-]+", "ENC~[REDACTED]"),
    )
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


_SAID = values("id, said", "1, 'password=abc123, token: xyz'", "2, 'Authorization: Bearer aa.bb.cc next'", "3, 'value ENC~QUJD+/=_- end'", "4, 'nothing here'", "5, 'dsn=root:x@tcp(h:1)/db;pwd = a\"b'", "6, 'api_key=visible bearer  ab/cd~e'")


@query(f"SELECT id, {_redact_sql('said')} AS said FROM ({_SAID}) UNION ALL SELECT doc_id, {_redact_sql('text')} FROM documents WHERE text IS NOT NULL")
def redact_text(spark, d):
    said = spark.sql(_SAID).select(F.col("id").cast("long").alias("id"), text.redacted(F.col("said")).alias("said"))
    return said.unionByName(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), text.redacted(F.col("text")).alias("said")))


_OPTIONS = values("id, k, v", "1, 'Password', 'x'", "1, 'host', 'h'", "2, 'connection_string', 'y'", "2, 'DSN', 'z'", "3, 'note', 'token: abc d'", "3, 'api_key', 'k'")


@query(f"SELECT id, k, CASE WHEN lower(k) IN ('password', 'passwd', 'pwd', 'secret', 'token', 'authorization', 'dsn', 'connection_string') THEN '[REDACTED]' ELSE {_redact_sql('v')} END AS v FROM ({_OPTIONS})")
def mask_secrets(spark, d):
    maps = spark.sql(_OPTIONS).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("details"))
    return maps.select("id", F.explode(text.masked(F.col("details"), maps.schema["details"].dataType)).alias("k", "v"))


_SINK_OPTIONS = values("id, k, v", "1, 'sasl_password', 'x'", "1, 'acks', '1'", "2, 'sasl_password', ''")


@query(f"SELECT id, k, CASE WHEN k = 'sasl_password' AND v <> '' THEN '******' ELSE v END AS v FROM ({_SINK_OPTIONS})")
def mask_sink_options(spark, d):
    maps = spark.sql(_SINK_OPTIONS).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("options"))
    return maps.select("id", F.explode(text.shown_options(F.col("options"))).alias("k", "v"))


@query("SELECT p_name, '`' || replace(p_name, '`', '``') || '`' AS quoted FROM part")
def quote_identifier(spark, d):
    return table(spark, d, "part").select("p_name", text.quoted(F.col("p_name")).alias("quoted"))


_LONG_NAMES = values("name, attempt", "'shop', 1", "'a_very_long_schema_name_that_goes_on_and_on_and_on_until_it_is_too_long', 2", "'short_in_letters_äöüäöüäöüäöüäöüäöüäöüäöü', 3")


@query(f"SELECT name, CASE WHEN length(name) + 10 <= 64 THEN 'mts_fl_v2:' || name ELSE 'mts_fl_v2:' || substr(sha256(name), 1, 54) END AS lock_name FROM ({_LONG_NAMES})")
def lock_names(spark, d):
    return spark.sql(_LONG_NAMES).select("name", text.lock_name(F.col("name")).alias("lock_name"))


@query(f"SELECT name, CASE WHEN strlen('__mts_staging_' || name || '_' || attempt) <= 64 THEN '__mts_staging_' || name || '_' || attempt ELSE '__mts_s_' || substr(sha256(name), 1, 16) || '_' || attempt END AS staging FROM ({_LONG_NAMES})")
def staging_names(spark, d):
    return spark.sql(_LONG_NAMES).select("name", text.staging_name(F.col("name"), F.col("attempt")).alias("staging"))


@query("SELECT user_id, name FROM (SELECT user_id, 'backup_' || event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n > 2")
def backup_retention(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", "event_id", F.concat(F.lit("backup_"), F.col("event_id")).alias("name"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("n > 2").select("user_id", "name")


@query("SELECT i AS attempt, least(100.0 * 2.0 ** i, 2000.0) AS batch_ms, least(300.0 * 3.0 ** i, 15000.0) AS writer_ms, least(5000.0 * 2.0 ** i, 60000.0) AS read_ms FROM range(8) AS r(i)")
def backoff_schedule(spark, d):
    i = F.col("id")
    return spark.range(8).select(i.alias("attempt"), text.backoff(i, 100.0, 2.0, 2000.0).alias("batch_ms"), text.backoff(i, 300.0, 3.0, 15000.0).alias("writer_ms"), text.backoff(i, 5000.0, 2.0, 60000.0).alias("read_ms"))


_ERRORS = values("message", "'Error 1213: Deadlock found'", "'read: connection reset by peer'", "'duplicate entry'", "'Lock wait timeout exceeded'", "'Invalid connection'", "'unexpected EOF'", "'Lost connection to server'", "'too many connections'", "'driver: connection was bad'", "'try restarting transaction'", "'i/o timeout'", "'deadlock found'", "'Server shutdown in progress'", "'malformed: unexpected packet'")


@query(f"""SELECT message, regexp_matches(lower(message), 'invalid connection|bad connection|connection refused|broken pipe|connection reset|connection was bad|lock wait timeout|try restarting transaction|server shutdown|lost connection|unexpected eof|unexpected packet') AS read,
regexp_matches(lower(message), 'deadlock|lock wait timeout|try restarting transaction') AS write, regexp_matches(lower(message), 'invalid connection|bad connection|unexpected packet|connection was bad|connection refused|broken pipe|connection reset') AS connection,
regexp_matches(lower(message), 'invalid connection|bad connection|unexpected packet|connection was bad') AS cursor_, regexp_matches(message, 'Error 1205|Error 1213|Lock wait timeout|Deadlock found') AS lock_ FROM ({_ERRORS})""")
def retryable_class(spark, d):
    m = F.col("message")
    return spark.sql(_ERRORS).select("message", *[text.retryable(m, k).alias(k) for k in ("read", "write", "connection")], text.retryable(m, "cursor").alias("cursor_"), text.retryable_lock(m).alias("lock_"))


@query("SELECT l, CASE WHEN h > 0 THEN h || 'h' || m || 'm' || s || 's' WHEN m > 0 THEN m || 'm' || s || 's' ELSE s || 's' END AS shown FROM (SELECT event_id AS l, event_id // 3600 AS h, event_id % 3600 // 60 AS m, event_id % 60 AS s FROM events)")
def ui_format(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("l"), text.duration(F.col("event_id")).alias("shown"))


# ---------------------------------------------------------------- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot and change log replayed, and every table reconciled against its target."""
    return row_count_status(spark, sf_dir)
