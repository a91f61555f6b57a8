"""Queries of schedules, filters, snapshots, readers, tables without a key and wire formats; each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changelog, eventlog, replay, tasks
from ..sources.readers import open_reader
from ..sources.tables import table
from .queries import _EVENTS, _LOG, QUERIES, _events, _log, _sort_sql, _TASKS, _tasks, query, values

# ---------------------------------------------------------------- schedules

_NOW = "cast(o_orderdate AS TIMESTAMP) + to_minutes(cast(o_orderkey % 1440 AS INTEGER)) + to_seconds(o_orderkey % 60)"


def _nows(spark, d):
    moment = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"), secs=F.col("o_orderkey") % 60)
    return table(spark, d, "orders").select("o_orderkey", moment.alias("now"))


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm")


@query(f"""SELECT o_orderkey, strftime(n + CASE WHEN extract('hour' FROM n) * 60 + extract('minute' FROM n) < 1050 AND isodow(n) < 6 THEN INTERVAL 0 DAY WHEN isodow(n) >= 5 THEN to_days(cast(8 - isodow(n) AS INTEGER)) ELSE INTERVAL 1 DAY END, '%Y-%m-%d') || ' ' ||
CASE WHEN isodow(n) > 5 OR extract('hour' FROM n) * 60 + extract('minute' FROM n) >= 1050 OR extract('hour' FROM n) < 9 THEN '09:00' ELSE strftime(date_trunc('hour', n) + to_minutes(cast((extract('minute' FROM n) // 30 + 1) * 30 AS INTEGER)), '%H:%M') END AS run
FROM (SELECT o_orderkey, {_NOW} AS n FROM orders)""")
def cron_next_office_hours(spark, d):
    """Every half hour from 9:00 to 17:30, Monday to Friday."""
    return _nows(spark, d).select("o_orderkey", _stamp(tasks.next_cron(F.col("now"), "*/30 9-17 * * mon-fri")).alias("run"))


@query(f"""SELECT o_orderkey, strftime(min(c), '%Y-%m-%d %H:%M') AS run FROM (SELECT o_orderkey, {_NOW} AS n FROM orders) JOIN
(SELECT unnest(generate_series(TIMESTAMP '1990-01-01 04:15:00', TIMESTAMP '2012-01-01', INTERVAL 1 DAY)) AS c) ON c > n AND c < n + INTERVAL 40 DAY AND (extract('day' FROM c) = 13 OR isodow(c) = 5) GROUP BY o_orderkey""")
def cron_next_day_or_weekday(spark, d):
    """4:15 on the 13th and on every Friday."""
    return _nows(spark, d).select("o_orderkey", _stamp(tasks.next_cron(F.col("now"), "15 4 13 * 5")).alias("run"))


_LAST = "(last_day({m}) - cast(greatest(isodow(last_day({m})) - 5, 0) AS INTEGER) + INTERVAL 22 HOUR + INTERVAL 30 MINUTE)"


@query(f"""SELECT o_orderkey, strftime(CASE WHEN {_LAST.format(m='n')} > n THEN {_LAST.format(m='n')} ELSE {_LAST.format(m="(date_trunc('month', n) + INTERVAL 1 MONTH)")} END, '%Y-%m-%d %H:%M') AS run FROM (SELECT o_orderkey, {_NOW} AS n FROM orders)""")
def cron_next_last_business_day(spark, d):
    return _nows(spark, d).select("o_orderkey", _stamp(tasks.next_last_business_day(F.col("now"), 22, 30)).alias("run"))


# ---------------------------------------------------------------- events, tasks


@query(f"SELECT seq, severity, code FROM {_EVENTS} WHERE task_id = 'task_1' AND visibility = 'DIAGNOSTIC' AND code = 'click' AND severity IN ('WARN', 'ERROR') AND seq > 10 ORDER BY seq DESC LIMIT 100")
def event_list_all_filters(spark, d):
    return eventlog.listed(_events(spark, d), "task_1", after=10, least="WARN", visibility="DIAGNOSTIC", code="click", execution_id="").select("seq", "severity", "code")


@query(f"SELECT id, name, (SELECT count(*) FROM ({_TASKS})) AS total FROM ({_TASKS}) ORDER BY {_sort_sql('name_asc')} LIMIT 10")
def task_page_total(spark, d):
    return tasks.page_with_total(_tasks(spark), "name_asc", 0, 0).select("id", "name", "total")


_SNAPSHOTS = values("id, status, updated_at", "'a', 'RUNNING', 10", "'b', 'RUNNING', 10", "'c', 'PAUSED', 10", "'gone', 'RUNNING', 10", "'e', 'RUNNING', 11")
_CURRENT = values("id, status, updated_at", "'a', 'RUNNING', 10", "'b', 'RUNNING', 11", "'c', 'RUNNING', 9", "'e', 'RUNNING', 10")


@query(f"SELECT s.id, s.status, s.updated_at FROM ({_SNAPSHOTS}) s JOIN ({_CURRENT}) c ON c.id = s.id AND c.status = s.status AND c.updated_at <= s.updated_at")
def snapshot_guard(spark, d):
    return tasks.fresh_snapshots(spark.sql(_SNAPSHOTS), spark.sql(_CURRENT))


_SKIP = values("task_id, level, db, tables_text", "'t1', 'TABLE', 'a', 'x,y'", "'t1', 'TABLE', 'b', ''", "'t2', 'DATABASE', 'c', ''", "'t3', 'TABLE', 'd', ' '")


@query(f"SELECT task_id, db FROM ({_SKIP}) WHERE NOT (level = 'TABLE' AND tables_text = '')")
def table_level_skip(spark, d):
    return spark.sql(_SKIP).where(~((F.col("level") == "TABLE") & (F.col("tables_text") == ""))).select("task_id", "db")


_DOCUMENTS = values("id, doc", """'a', '{"status": "RUNNING", "progress": "12.345", "tables": [{"name": "orders"}, {"name": "parts"}]}'""", """'b', '{"status": "FAILED", "progress": 7, "tables": []}'""", """'c', '{"progress": null, "tables": [{"name": "Order_lines"}]}'""")


@query(f"SELECT id, doc ->> '$.status' AS status, cast(cast(doc ->> '$.progress' AS DECIMAL(10,2)) AS DOUBLE) AS progress, contains(lower(cast(doc -> '$.tables' AS VARCHAR)), 'order') AS found FROM ({_DOCUMENTS})")
def task_json_search(spark, d):
    doc = F.col("doc")
    names = F.from_json(F.get_json_object(doc, "$.tables"), "array<struct<name:string>>")
    progress = F.get_json_object(doc, "$.progress").cast("decimal(10,2)").cast("double")
    return spark.sql(_DOCUMENTS).select("id", F.get_json_object(doc, "$.status").alias("status"), progress.alias("progress"), F.exists(names, lambda t: F.lower(t["name"]).contains("order")).alias("found"))


# ---------------------------------------------------------------- names and keys

_PARTS = values("id, parts, wanted", "1, '`a`,`B`(10)', 'A,b'", "2, 'a (5) , b', 'a,b'", "3, '`a`', 'a,b'", "4, '', ''", "5, ' , `x`', 'x'", "6, 'b,a', 'a,b'")


@query(f"""SELECT id, array_to_string(c, ',') AS names, wanted <> '' AND list_transform(c, lambda x: lower(x)) = string_split(lower(wanted), ',') AS same FROM
(SELECT id, wanted, list_transform(list_filter(list_transform(string_split(parts, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '`[^`]*`') THEN regexp_extract(x, '`([^`]*)`', 1) ELSE trim(split_part(x, '(', 1)) END) AS c FROM ({_PARTS}))""")
def index_parts(spark, d):
    wanted = F.filter(F.split("wanted", ","), lambda x: x != "")
    return spark.sql(_PARTS).select("id", F.array_join(text.index_columns(F.col("parts")), ",").alias("names"), text.same_columns(F.col("parts"), wanted).alias("same"))


@query("SELECT event_id, coalesce(cast(user_id AS VARCHAR), '') || '|' || coalesce(cast(CASE WHEN event_id % 3 = 0 THEN event_type END AS VARCHAR), '') AS key FROM events")
def key_texts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.concat_ws("|", text.key_text(F.col("user_id")), text.key_text(F.when(F.col("event_id") % 3 == 0, F.col("event_type")))).alias("key"))


_BACKUPS = values("name", "'__mts_old_shop_20240101'", "'__mts_old_shopping_20240101'", "'__mts_oldXshop_2'", "'__mts_old_shop'", "'xmts_old_shop_1'")


@query(f"SELECT name FROM ({_BACKUPS}) WHERE name LIKE '__mts_old_shop_%'")
def backup_names_like(spark, d):
    """An underscore of the pattern stands for any character, as the lookup has it."""
    return spark.sql(_BACKUPS).where(F.col("name").like("__mts_old_shop_%"))


# ---------------------------------------------------------------- readers, transactions, tables without a key


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey > 50 OR (l_orderkey = 50 AND l_linenumber > 3)) AND (l_orderkey < 4000 OR (l_orderkey = 4000 AND l_linenumber <= 2))")
def reader_range_stream(spark, d):
    return open_reader(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "PK_STRATEGY", ["l_orderkey", "l_linenumber"], [50, 3], [4000, 2])


@query("SELECT user_id, event_type, value FROM events")
def reader_without_key(spark, d):
    return open_reader(table(spark, d, "events").select("user_id", "event_type", "value"), "FULL_COLUMNS_STRATEGY", [])


@query(f"SELECT txn, max(file) AS file, max(commit_pos) AS pos, count(*) FILTER (WHERE op = 'DELETE') AS n_writes, count(*) FILTER (WHERE op = 'DELETE') = 0 AS aborted FROM {_LOG} GROUP BY txn")
def txn_checkpoints(spark, d):
    """A sink that takes deletions only: transactions without one are dropped, and their positions are saved all the same."""
    return changelog.checkpoints(_log(spark, d), F.col("op") == "DELETE")


_TUPLES = "SELECT event_id AS ord, user_id % 50 AS u, CASE WHEN event_id % 13 <> 0 THEN event_type END AS t FROM events"


@query(f"SELECT ord, u, t FROM ({_TUPLES}) WHERE u = 7 AND t = 'click'")
def key_equality_without_nulls(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 50).alias("u"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("t"))
    return e.where(replay.matches({"u": F.lit(7), "t": F.lit("click")}))


@query(f"SELECT a.ord, count(b.ord) AS n FROM (SELECT * FROM ({_TUPLES}) WHERE ord % 97 = 0) a LEFT JOIN ({_TUPLES}) b ON a.u = b.u AND a.t = b.t GROUP BY a.ord")
def full_column_matches(spark, d):
    """Of images without a key, how many rows each could match: an image with a null matches none."""
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 50).alias("u"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("t"))
    images = e.where("ord % 97 = 0").select(F.col("ord").alias("of"), F.col("u").alias("iu"), F.col("t").alias("it"))
    n = e.groupBy("u", "t").agg(F.count("*").alias("n"))
    return images.join(n, replay.matches({"u": F.col("iu"), "t": F.col("it")}), "left").select(F.col("of").alias("ord"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def replay_bag_with_updates(spark, d):
    """Of a table without a key, rows and multiplicities after a log with UPDATEs: an ordered fold, without SQL."""
    log = _log(spark, d).select(F.col("event_id").alias("ord"), "op", F.col("new_key").alias("u"), (F.col("event_id") % 3).alias("g"), F.col("old_key").alias("old_u"), ((F.col("event_id") + 1) % 3).alias("old_g"))
    base = table(spark, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("u"), (F.col("event_id") % 3).alias("g")).agg(F.count("*").alias("n"))
    return replay.bag_folded(log, base, ["u", "g"])


QUERIES["replay_bag_with_updates"] = replay_bag_with_updates
