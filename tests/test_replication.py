"""Replication operators against step-by-step simulations, and every query against its oracle SQL."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import more, outputs  # noqa: F401
from tidemark.functions import text
from tidemark.operators import audit, batching, changelog, chunks, control, ddl, keyset, metrics, replay, tasks
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.sources.published import PublishedTable
from tidemark.sources.tables import json_lines
from tidemark.streaming.apply import LOG, AppliedTable, run_available

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def random_log(seed, n=80, keys=6):
    r = random.Random(seed)
    out = []
    for k in range(n):
        old = r.randrange(keys)
        op = r.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        out.append((k, k // 4, 4, f"bin.{1 + k // 40:06d}", 4 + 64 * (k // 4 * 4 + 3), op, old, r.randrange(keys) if op == "UPDATE" and r.random() < 0.3 else old, float(k)))
    return out


def simulate(log, rows):
    rows, missed = dict(rows), []
    for k, _, _, _, _, op, old, new, value in log:
        if op == "INSERT":
            rows[old] = value
        elif op == "DELETE":
            if rows.pop(old, None) is None:
                missed.append((old, k))
        elif old != new:
            if rows.pop(old, None) is None:
                missed.append((old, k))
            rows[new] = value
        elif old in rows:
            rows[old] = value
        else:
            missed.append((old, k))
    return rows, missed


@pytest.mark.parametrize("seed", range(6))
def test_keyed_replay(spark, seed):
    log = random_log(seed)
    frame = spark.createDataFrame(log, LOG)
    rows, _ = simulate(log, {0: -1.0, 3: -2.0})
    base = spark.createDataFrame([(0, -1.0), (3, -2.0)], "key long, value double")
    assert {r.key: r.value for r in replay.keyed(replay.operations(frame, base)).collect()} == rows
    _, missed = simulate(log, {})
    assert sorted((r.key, r.ord) for r in replay.unmatched(replay.operations(frame)).collect()) == sorted(missed)


def test_bag_replay(spark):
    r = random.Random(9)
    log = [(r.randrange(4), k, r.choice(["INSERT", "DELETE"])) for k in range(200)]
    n = {0: 2, 1: 1}
    for key, _, op in log:
        n[key] = max(0, n.get(key, 0) + (1 if op == "INSERT" else -1))
    got = replay.bag(spark.createDataFrame(log, "key int, ord long, op string"), spark.createDataFrame([(0, 2), (1, 1)], "key int, n int"), ["key"])
    assert {x.key: x.n for x in got.collect()} == {k: v for k, v in n.items() if v}


def test_bag_replay_with_updates_and_nulls(spark):
    r = random.Random(12)
    value = lambda: r.choice([0, 1, 2, None])
    log = [(k, r.choice(["INSERT", "UPDATE", "DELETE"]), value(), "x", value(), "x") for k in range(300)]
    n = {(0, "x"): 2, (None, "x"): 1}
    for _, op, new, t, old, u in log:
        gone = (new, t) if op == "DELETE" else (old, u) if op == "UPDATE" else None
        if gone is not None:
            if None in gone or not n.get(gone):
                continue
            n[gone] -= 1
        if op != "DELETE":
            n[new, t] = n.get((new, t), 0) + 1
    frame = spark.createDataFrame(log, "ord long, op string, a int, b string, old_a int, old_b string")
    base = spark.createDataFrame([(0, "x", 2), (None, "x", 1)], "a int, b string, n int")
    assert {(x.a, x.b): x.n for x in replay.bag_folded(frame, base, ["a", "b"]).collect()} == {k: v for k, v in n.items() if v}
    plain = [x for x in log if x[1] != "UPDATE"]
    n = {(0, "x"): 2, (None, "x"): 1}
    for _, op, new, t, *_ in plain:
        if op == "INSERT":
            n[new, t] = n.get((new, t), 0) + 1
        elif new is not None and n.get((new, t)):
            n[new, t] -= 1
    got = replay.bag(spark.createDataFrame(plain, frame.schema), base, ["a", "b"])
    assert {(x.a, x.b): x.n for x in got.collect()} == {k: v for k, v in n.items() if v}


def test_partial_images_and_drift_with_nulls(spark):
    log = spark.createDataFrame([(1, "k", 2.0, ["v"]), (2, "k", None, ["v"]), (3, "k", 9.0, [])], "event_id int, key string, v double, present array<string>")
    assert [r.v for r in replay.latest_fields(log, "key", ["v"]).collect()] == [None]
    source = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 1.0)], "k int, v double")
    target = spark.createDataFrame([(1, None), (2, None), (5, None), (4, 1.0)], "k int, v double")
    assert sorted((r.k, r.kind) for r in replay.drift(source, target, "k", "v").collect()) == [(2, "different"), (3, "missing"), (5, "extra")]


def test_events_without_rows_are_an_error(spark):
    frame = spark.createDataFrame([(1, "INSERT", [5]), (2, "DELETE", [])], "txn int, op string, images array<bigint>")
    with pytest.raises(Exception, match="DELETE event without rows"):
        changelog.exploded(frame).collect()


def test_nested_details_are_masked(spark):
    frame = spark.sql("SELECT named_struct('Token', 'x', 'note', 'pwd: a b', 'more', array(named_struct('dsn', 'y', 'n', 1)), 'said', array('Bearer q'), 'opts', map('SECRET', 'z', 'host', 'h')) AS d")
    got = frame.select(text.masked(F.col("d"), frame.schema["d"].dataType).alias("d")).first().d
    assert got.Token == "[REDACTED]" and got.note == "pwd=[REDACTED] b" and got.more[0].dsn == "[REDACTED]" and got.more[0].n == 1
    assert got.said == ["Bearer [REDACTED]"] and got.opts == {"SECRET": "[REDACTED]", "host": "h"}


def test_schedules_against_every_minute(spark):
    import datetime as dt

    start = dt.datetime(2024, 2, 26, 23, 58, 30)
    for said, fits in (
        ("5,35 */6 * * *", lambda t: t.minute in (5, 35) and t.hour % 6 == 0),
        ("0 12 29 feb ?", lambda t: (t.month, t.day, t.hour, t.minute) == (2, 29, 12, 0)),
        ("10-20/5 8 1 * mon", lambda t: t.minute in (10, 15, 20) and t.hour == 8 and (t.day == 1 or t.weekday() == 0)),
        ("@monthly", lambda t: (t.day, t.hour, t.minute) == (1, 0, 0)),
    ):
        nows = [start + dt.timedelta(minutes=97 * k) for k in range(40)]
        want = []
        for now in nows:
            t = now.replace(second=0) + dt.timedelta(minutes=1)
            while not fits(t) and t < now + dt.timedelta(days=40):
                t += dt.timedelta(minutes=1)
            want.append(t)
        frame = spark.createDataFrame(list(enumerate(nows)), "k int, now timestamp_ntz")
        got = [r.run for r in frame.select("k", tasks.next_cron(F.col("now"), said).alias("run")).orderBy("k").collect()]
        assert [(a if b < n + dt.timedelta(days=40) else None) for a, b, n in zip(got, want, nows, strict=True)] == [(b if b < n + dt.timedelta(days=40) else None) for b, n in zip(want, nows, strict=True)]


def test_stream_is_batch_once(spark, tmp_path):
    log = random_log(3)
    path = f"file://{tmp_path}"
    cut = 42  # inside a transaction
    table = AppliedTable(spark, f"{path}/table")
    spark.createDataFrame(log[:cut], LOG).coalesce(1).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(LOG).parquet(f"{path}/log")
    run_available(stream, table, f"{path}/checkpoint")
    assert {r.key: r.value for r in table.rows().collect()} == simulate(log[:40], {})[0]
    spark.createDataFrame(log[cut:], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    run_available(stream, table, f"{path}/checkpoint")
    want = simulate(log, {})[0]
    assert {r.key: r.value for r in table.rows().collect()} == want
    mark = table.mark()
    run_available(stream, table, f"{path}/checkpoint")
    run_available(stream, table, f"{path}/another")  # the whole log again
    assert table.mark() == mark and {r.key: r.value for r in table.rows().collect()} == want


def test_stream_writes_only_touched_buckets(spark, tmp_path):
    table = AppliedTable(spark, f"file://{tmp_path}/t", buckets=4, kept=2)
    log = [(k, k, 1, "bin.000001", 4 + 64 * k, "INSERT", k % 40, k % 40, float(k)) for k in range(40)]
    log += [(40, 40, 1, "bin.000001", 4 + 64 * 40, "UPDATE", 3, 3, -1.0), (41, 41, 1, "bin.000001", 4 + 64 * 41, "DELETE", 4, 4, 0.0), *[(k, k, 1, "bin.000001", 4 + 64 * k, "DELETE", k - 42, k - 42, 0.0) for k in range(42, 82)]]
    seen = []
    for a, b in ((0, 40), (40, 41), (41, 42), (42, 82)):
        table.apply(spark.createDataFrame(log[a:b], LOG))
        assert {r.key: r.value for r in table.rows().collect()} == simulate(log[:b], {})[0]
        seen.append(list(table.mark()["buckets"]))
    assert seen[0] == [0] * 4 and sum(v == 1 for v in seen[1]) == 1 and sum(v == 2 for v in seen[2]) == 1 and seen[3] == [-1] * 4
    named = {f"{v}/bucket={b}" for m in seen[-2:] for b, v in enumerate(m) if v >= 0}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t" / "rows").glob("*/bucket=*")} == named


def test_upper_bound_forms_agree(spark):
    r = random.Random(2)
    frame = spark.createDataFrame([(r.randrange(4), r.randrange(4), r.randrange(4)) for _ in range(60)], "a int, b int, c int")
    for _ in range(10):
        v = [r.randrange(4) for _ in range(3)]
        x, y = keyset.up_to(["a", "b", "c"], v), keyset.up_to_by_equality(["a", "b", "c"], v)
        assert frame.where(x != y).isEmpty() and frame.where(x & keyset.after(["a", "b", "c"], v)).isEmpty()


def test_keyset_predicate_reaches_the_scan(spark):
    plan = keyset.page(spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderkey"], [5], [90])._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "LessThanOrEqual(o_orderkey,90)" in plan


def test_chunks_cover_every_row_once(spark):
    for keys in ([], [5], [-(2**63), 2**63 - 1], [1, 2, 3, 50, 51, 999], list(range(100))):
        frame = spark.createDataFrame([(k,) for k in keys], "k long")
        plan = chunks.int_range(frame, "k", 7)
        assert sorted(r.k for r in chunks.assigned(frame, "k", plan).collect()) == sorted(keys)


def test_numbering_without_one_task(spark):
    keys = random.Random(1).sample(range(10000), 500)
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    assert {r.k: r.rn for r in chunks.numbered(frame, "k", 8).collect()} == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_numbering_of_text_composite_and_null_keys(spark):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "\u00e9", "z", "\U00010000", "\uffff"]), r.choice([None, 1, 2, 3]), k) for k in range(300)]
    frame = spark.createDataFrame(rows, "a string, b int, k int")
    text = lambda a: (a is not None, (a or "").encode())
    for names, place in ((["a", "b", "k"], lambda x: (text(x[0]), x[1] is not None, x[1] or 0, x[2])), (["k"], lambda x: x[2])):
        want = {x[2]: i + 1 for i, x in enumerate(sorted(rows, key=place))}
        for buckets in (1, 7, None):
            assert {x.k: x.rn for x in chunks.numbered(frame, names, buckets).collect()} == want
    hot = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "a string")
    assert sorted(x.rn for x in chunks.numbered(hot, "a", 8).collect()) == list(range(1, 101))
    assert chunks.nth_row(spark.createDataFrame([], "a string"), "a", 2, 5).collect() == []


def test_null_key_is_in_the_first_chunk(spark):
    frame = spark.createDataFrame([(None,), (1,), (9,)], "k long")
    assert sorted((r.k is None, r.k or 0, r.chunk_id) for r in chunks.assigned(frame, "k", chunks.int_range(frame, "k", 3)).collect()) == [(False, 1, 0), (False, 9, 2), (True, 0, 0)]


def test_buffered_flushes_against_a_buffer(spark):
    r = random.Random(8)
    rows = [(g, k, t) for g in "ab" for k, t in enumerate(sorted(r.randrange(100) for _ in range(70)))]
    want = []
    for g in "ab":
        held, written, tick = [], [], 0
        for _, k, t in [x for x in rows if x[0] == g]:
            if t // 10 != tick:
                tick, held, written = t // 10, [], written + ([held] if held else [])
            held.append(k)
            if len(held) == 4:
                held, written = [], [*written, held]
        want += [(g, tuple(w)) for w in [*written, held] if w]
    got = batching.buffered(spark.createDataFrame(rows, "g string, k long, t long"), "g", "k", "t", 4, 10).groupBy("g", "tick", "part").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    assert sorted((x.g, tuple(x.ks)) for x in got.collect()) == sorted(want)


def test_audit_log(spark, tmp_path):
    import datetime as dt

    path = f"file://{tmp_path}/audit"
    day = dt.datetime(2024, 5, 1, 10)
    rows = [(day + dt.timedelta(hours=9 * k), f"t{k % 2}", "ERROR", "", None, "p", False, "", {}, 0) for k in range(8)]
    audit.append(spark.createDataFrame([*rows, (None, "t9", "ERROR", "x", "s", "", True, "e", {"a": "b"}, 5)], audit.EVENT), path)
    some = next((tmp_path / "audit" / "day=2024-05-01").glob("*.json"))
    assert all(set(json.loads(x)) == {"timestamp", "task_id", "event_type", "position", "success"} for x in some.read_text().split("\n") if x)
    (tmp_path / "audit" / "day=2024-05-01" / "more.json").write_text('{"timestamp": "2024-05-01T\n\n')
    assert audit.find(spark, path).count() == 9
    found = audit.find(spark, path, "t0", "ERROR", rows[2][0], rows[6][0], limit=2).collect()
    assert [(x.timestamp, x.rows_affected, x.error_msg) for x in found] == [(rows[2][0], None, None), (rows[4][0], None, None)]
    last = audit.find(spark, path, "t9").first()
    assert last.timestamp is not None and (last.details, last.rows_affected, last.schema) == ({"a": "b"}, 5, "s")


def test_metric_samples(spark):
    frame = spark.createDataFrame([("c", "counter", 1, 2), ("c", "counter", 2, 3), ("g", "gauge", 9, 7), ("g", "gauge", 3, 8), ("h", "histogram", 1, 1), ("h", "histogram", 2, 40)], "name string, kind string, ord int, value int")
    got = {r.line for r in metrics.exposition(metrics.samples(frame, ("0.5", "1", "10")), "x_").collect()}
    assert got == {"x_c 5.0", "x_g 7.0", 'x_h_bucket{le="0.5"} 0.0', 'x_h_bucket{le="1"} 1.0', 'x_h_bucket{le="10"} 1.0', 'x_h_bucket{le="+Inf"} 2.0', "x_h_sum 41.0", "x_h_count 2.0"}
    assert metrics.samples(frame.limit(0)).collect() == []


def test_definitions_without_indexes(spark):
    text_ = "CREATE TABLE `t` (\n  `id` bigint AUTO_INCREMENT,\n  `key` int,\n  PRIMARY KEY (`id`),\n  KEY `by_id` (`key`,`id`),\n  UNIQUE KEY `u` (`key`),\n  KEY `v` (`key`) \n) ENGINE=InnoDB"
    kept = "CREATE TABLE `t` (\n  `id` bigint AUTO_INCREMENT,\n  `key` int,\n  PRIMARY KEY (`id`),\n  KEY `by_id` (`key`,`id`)"
    frame = spark.createDataFrame([(text_,)], "d string")
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    got = frame.select(ddl.without_indexes(F.col("d")).alias("a"), ddl.without_indexes(F.col("d"), names("v")).alias("b"), ddl.without_indexes(F.col("d"), names()).alias("c")).first()
    assert got.a == kept + "\n) ENGINE=InnoDB"
    assert got.b == kept + ",\n  UNIQUE KEY `u` (`key`)\n) ENGINE=InnoDB"
    assert got.c == text_


def test_folds(spark):
    r = random.Random(4)
    rows = [(g, k, r.randint(1, 60)) for g in "ab" for k in range(90)]
    frame = spark.createDataFrame(rows, "g string, k long, s long")
    for f, cut in ((batching.reader_batches, lambda n, held, s: n >= 5 or held >= 100), (batching.writer_statements, lambda n, held, s: n >= 5 or held + s > 100)):
        want = []
        for g in "ab":
            b = n = held = 0
            for _, k, s in [x for x in rows if x[0] == g]:
                if n and cut(n, held, s):
                    b, n, held = b + 1, 0, 0
                n, held = n + 1, held + s
                want.append((g, k, b))
        assert sorted((x.g, x.k, x.batch) for x in f(frame, "g", "k", "s", 5, 100).collect()) == sorted(want)


def test_published_table(spark, tmp_path):
    table = PublishedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    for n in (3, 4, 5):
        table.publish(spark.range(n), backups=1)
        assert table.read().count() == n
    spark.range(9).write.parquet(f"file://{tmp_path}/t/staging-unfinished")  # a load that failed before its mark
    assert table.read().count() == 5
    there = [m["version"] for m in table.versions() if (tmp_path / "t" / m["folder"]).exists()]
    assert there == [2, 1]


def test_log_lines_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "a.bak").write_text('{"seq": 1, "code": "x"}\n\n{"seq": 2, "co\n')
    (tmp_path / "b.log").write_text('{"seq": 3, "code": "y", "more": 1}\nnot json\n')
    rows = json_lines(spark, f"file://{tmp_path}", "seq long, code string").collect()
    assert sorted((r.seq, r.code) for r in rows) == [(1, "x"), (3, "y")]


def test_sealed_text(spark):
    frame = spark.createDataFrame([("",), ("a" * 300,), ("\u00fc\u6f22",), (None,)], "s string")
    sealed = frame.select("s", text.sealed(F.col("s"), "k").alias("x"))
    rows = sealed.select("s", "x", text.opened(F.col("x"), "k").alias("y"), text.opened(F.col("s"), "k").alias("z")).collect()
    assert all(r.y == r.s == r.z for r in rows)
    assert all(r.x.startswith("ENC~") and "\n" not in r.x for r in rows if r.s is not None)


def test_insert_text():
    assert control.insert_text("a`b", ["k"], ["k"], 1, "upsert") == "INSERT IGNORE INTO `a``b` (`k`) VALUES (?)"
    assert control.insert_text("t", [], [], 2, "plain") == "INSERT INTO `t` () VALUES (), ()"


def test_heartbeat_and_key_order_edges(spark):
    got = spark.createDataFrame([(w,) for w in (-5, 0, 1, 2, 3, 45, 46)], "w long").select(control.heartbeat_seconds(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [15.0, 15.0, 1.0, 1.0, 1.0, 15.0, 15.0]
    pairs = [("007", "7", 0), ("1.5", "10", -1), (None, None, 0), ("a", "B", 1)]
    frame = spark.createDataFrame(pairs, "a string, b string, want int")
    assert all(r.got == r.want for r in frame.select("want", control.key_order(F.col("a"), F.col("b")).alias("got")).collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    want = sorted(repr([plain(v) for v in r]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_folder_is_the_named_one():
    from types import SimpleNamespace

    from tidemark.session import shared_folder

    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://h:7077", "/shared/"), "x").startswith("/shared/tidemark-x/")
    assert shared_folder(session("local[8]", None), "x").startswith("file:///")
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None), "x")
