"""Audit log: JSON lines in one folder a day, appended; read back with filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "timestamp timestamp_ntz, task_id string, event_type string, table_name string, schema string, position string, success boolean, error_msg string, details map<string,string>, rows_affected long"
#: Text fields that a line leaves out where they are empty.
OPTIONAL = ("table_name", "schema", "position", "error_msg")


def append(events: DataFrame, path: str) -> None:
    """Adds events (columns of EVENT) to the log; one without a time gets the present. Empty optional fields are left out."""
    out = events.withColumn("timestamp", F.coalesce("timestamp", F.localtimestamp()))
    for c in OPTIONAL:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    out = out.withColumn("rows_affected", F.nullif(F.col("rows_affected"), F.lit(0).cast("long"))).withColumn("details", F.when(F.size("details") > 0, F.col("details")))
    out.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").mode("append").json(path)


def find(spark: SparkSession, path: str, task_id: str = "", event_type: str = "", start: datetime | None = None, end: datetime | None = None, limit: int = 0) -> DataFrame:
    """Events of a task and type ("": any) from start to end, both included, the first `limit` by time (0: all). Broken lines are
    left out; days out of the range are not read."""
    out = spark.read.schema(f"{EVENT}, day date").option("mode", "DROPMALFORMED").json(path).where("timestamp is not null")
    if task_id:
        out = out.where(F.col("task_id") == task_id)
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if start is not None:
        out = out.where((F.col("day") >= F.lit(start.date())) & (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        out = out.where((F.col("day") <= F.lit(end.date())) & (F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")))
    out = out.drop("day")
    return out.orderBy("timestamp").limit(limit) if limit else out
