"""Table readers, and the change log, targets and catalogs derived from given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_scan(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows of the half-open key range [low, high): pushed to the scan."""
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def change_log(events: DataFrame) -> DataFrame:
    """A row-level change log out of an event table: op, keys, and where it stands in a numbered log file."""
    txn = F.floor(F.col("event_id") / 7).cast("long")
    pos = F.lit(4) + (F.col("event_id") % 1001) * 64
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    users = events.agg((F.max("user_id") + 1).alias("n_users"))
    log = events.join(F.broadcast(users))  # one row: the key space
    moved = (op == "UPDATE") & (F.col("event_id") % 11 == 0)
    log = log.select(
        "event_id", txn.alias("txn"),
        F.concat(F.lit("mysql-bin."), F.lpad((F.floor(txn / 143) + 1).cast("string"), 6, "0")).alias("file"),
        pos.alias("pos"), op.alias("op"), F.col("user_id").alias("old_key"),
        F.when(moved, (F.col("user_id") + 1) % F.col("n_users")).otherwise(F.col("user_id")).alias("new_key"),
        "event_type", "value",
    )
    commit = log.groupBy("txn").agg(F.max("pos").alias("commit_pos"))
    return log.join(commit, "txn")


def drifted_target(orders: DataFrame) -> DataFrame:
    """A replica of orders that has lost keys, changed totals and gained keys."""
    kept = orders.where(F.col("o_orderkey") % 17 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 23 == 0, 1.0).otherwise(0.0))
    top = orders.agg(F.max("o_orderkey").alias("top"))
    extra = orders.where("o_orderkey < 5").join(F.broadcast(top)).withColumn("o_orderkey", F.col("o_orderkey") + F.col("top") + 1).drop("top")
    return kept.unionByName(extra)
