"""Checks of servers, sinks, events and tasks: each gives the first rule that a row breaks, or an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import eventlog

#: Sink types, choices of the message sink, visibilities, codes that are never held back, grants that replication needs.
SINK_TYPES = ("MYSQL", "KAFKA", "HTTP_WEBHOOK")
ROUTINGS, KEY_MODES, ACKS = ("single_topic", "per_table"), ("pk", "none"), (-1, 0, 1)
VISIBILITIES = ("KEY", "DIAGNOSTIC")
ALWAYS_SHOWN = ("TASK_STARTED", "TASK_FAILED", "TASK_COMPLETED", "TASK_STOPPED", "TASK_PAUSED", "TASK_RESUMED", "TASK_SCHEDULED", "TASK_CONFIG_EFFECTIVE")
GRANTS = ("REPLICATION SLAVE", "REPLICATION CLIENT", "SELECT")


def first_broken(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule whose condition holds; a null condition does not hold."""
    return F.coalesce(*[F.when(broken, name) for broken, name in rules], F.lit(""))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def log_settings(log_bin: Column, log_format: Column) -> Column:
    return first_broken((~log_bin.isin("ON", "1"), "log_bin"), (log_format != "ROW", "binlog_format"))


def missing_grants(grants: Column) -> Column:
    """Of an array of grant lines, the needed grants that no line holds; ALL PRIVILEGES holds every one."""
    has = lambda what: F.exists(grants, lambda g: g.contains(what) | g.contains("ALL PRIVILEGES"))
    return F.filter(F.array(*[F.when(~has(g), g) for g in GRANTS]), lambda g: g.isNotNull())


def message_sink() -> Column:
    """Over columns brokers (array), routing, topic, prefix, key_mode, batch, acks, mechanism, username, cert, cert_key, tls."""
    certs = F.coalesce("cert", F.lit("")) != F.lit("")
    keys = F.coalesce("cert_key", F.lit("")) != F.lit("")
    return first_broken(
        (F.size("brokers") < 1, "brokers"), (F.exists("brokers", lambda b: F.trim(b) == ""), "broker"),
        (~F.col("routing").isin(*ROUTINGS), "routing"), ((F.col("routing") == "single_topic") & _blank("topic"), "topic"), ((F.col("routing") == "per_table") & _blank("prefix"), "prefix"),
        (~F.col("key_mode").isin(*KEY_MODES), "key_mode"), (F.col("batch") <= 0, "batch"), (~F.col("acks").isin(*ACKS), "acks"),
        (~_blank("mechanism") & _blank("username"), "username"), (certs != keys, "certificate pair"), (certs & ~F.col("tls"), "tls"),
    )


def request_sink() -> Column:
    """Over columns url, timeout_ms, retries, backoff_ms."""
    return first_broken((_blank("url"), "url"), (~F.col("url").rlike("^https?://"), "scheme"), (~F.col("url").rlike("^https?://[^/]+"), "host"), (F.col("timeout_ms") <= 0, "timeout"), (F.col("retries") < 0, "retries"), (F.col("backoff_ms") < 0, "backoff"))


def event() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    need = [(empty(c), c) for c in ("task_id", "execution_id", "event_id", "code", "message")]
    return first_broken(*need, (eventlog.severity_rank(F.col("severity")) < 0, "severity"), (~F.col("visibility").isin(*VISIBILITIES), "visibility"))


def always_shown(code: Column) -> Column:
    """Codes that aggregation of repeats never holds back."""
    return code.isin(*ALWAYS_SHOWN) | code.startswith("PHASE_") | code.endswith("_EXHAUSTED")


def comparison() -> Column:
    """Whether rows may be counted, over columns status, mode, full_done, relational, checking."""
    return first_broken((~F.col("status").isin("COMPLETED", "STOPPED"), "status"), (~F.col("mode").isin("FULL", "ALL"), "mode"), (~F.col("full_done"), "full load"), (~F.col("relational"), "target"), (F.col("checking"), "running"))


def restart() -> Column:
    """Whether a task may start again, over columns mode, phase, old_marks, drop_first: an interrupted full load starts afresh only."""
    interrupted = F.col("phase").isin("FULL_STARTED", "FULL_FAILED") & ~F.col("drop_first")
    mode = F.upper("mode")
    return first_broken(((mode == "ALL") & (F.col("old_marks") > 0) & interrupted, "old marks"), (mode.isin("FULL", "ALL") & interrupted, "interrupted"))


def run_plan() -> Column:
    """What a start does, over columns mode, full_done, relational."""
    mode = F.upper("mode")
    return (
        F.when((mode != "INCREMENTAL") & ~F.col("relational"), "refused: target")
        .when((mode == "INCREMENTAL") & ~F.col("full_done"), "refused: no full load")
        .when((mode == "INCREMENTAL") | ((mode == "ALL") & F.col("full_done")), "incremental")
        .when(mode == "ALL", "full, then incremental")
        .otherwise("full")
    )
