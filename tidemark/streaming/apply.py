"""Applying a stream of changes to a table, whole transactions at a time and each once.

A micro-batch becomes a new version of the table. Keys are dealt into buckets, and only the buckets that the batch touches are
written anew; of the others a version names the folders that are there already. Its rows are written first, then what is left of unfinished transactions,
then its mark (the greatest commit position it holds); a version counts once its mark is there. A batch that is run again
after a failure overwrites its unmarked version; changes at or below the mark are skipped, so that a stream which is
replayed from an earlier point changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog, replay
from ..session import shared_folder

LOG = "event_id long, txn long, txn_rows long, file string, commit_pos long, op string, old_key long, new_key long, value double"
ROWS = "key long, value double"
MARK = "version long, file string, pos long, buckets array<long>"
#: Buckets that the keys of a table are dealt into, and versions that stay readable.
BUCKETS, KEPT = 16, 2


class AppliedTable:
    """buckets of a mark: for each bucket the version that wrote it last, -1 where it holds no row. The number of buckets is
    fixed by the first batch: choose it so that a bucket fits a task well."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, kept: int = KEPT):
        self.spark, self.path, self.buckets, self.kept = spark, path, buckets, max(kept, 1)

    def _fs(self, part: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, part: str, schema: str) -> DataFrame | None:
        where, fs = self._fs(part)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if fs.exists(where) else None

    def _marks(self) -> list:
        """Newest first: as many as are kept, and those before them while they are there."""
        marks = self._read("marks", MARK)
        return marks.orderBy(F.desc("version")).limit(self.kept + 1).collect() if marks is not None else []

    def mark(self):
        """Row of the newest version, or None."""
        return next(iter(self._marks()), None)

    def _rows(self, mark, wanted: set[int] | None = None) -> DataFrame:
        """Rows of the wanted buckets (None: all) of the version."""
        at = [] if mark is None else mark["buckets"]
        paths = [f"{self.path}/rows/{v}/bucket={b}" for b, v in enumerate(at) if v >= 0 and (wanted is None or b in wanted)]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def rows(self) -> DataFrame:
        return self._rows(self.mark())

    def apply(self, batch: DataFrame, _epoch: int = 0) -> None:
        mark = self.mark()
        version = 0 if mark is None else mark["version"] + 1
        at_now = [-1] * self.buckets if mark is None else list(mark["buckets"])
        todo = batch.select(*[c.split()[0] for c in LOG.split(", ")])
        if mark is not None:
            left = self._read(f"unfinished/{mark['version']}", LOG)
            todo = todo if left is None else todo.unionByName(left)
            at = changelog.position(F.col("file"), F.col("commit_pos"))
            todo = todo.where(at > changelog.position(F.lit(mark["file"]), F.lit(mark["pos"]).cast("long")))
        todo = todo.dropDuplicates(["event_id"]).cache()
        sizes = todo.groupBy("txn").agg((F.count("*") == F.max("txn_rows")).alias("whole"))
        # Transactions are applied in order: none that comes after an unfinished one.
        open_ = todo.join(sizes.where("not whole"), "txn").agg(F.min("txn").alias("t")).first()["t"]
        ready = todo if open_ is None else todo.where(F.col("txn") < open_)
        last = ready.agg(F.max(changelog.position(F.col("file"), F.col("commit_pos"))).alias("p")).first()["p"]
        if last is None and todo.isEmpty():
            todo.unpersist()
            return
        file, pos = (last["file"], last["pos"]) if last is not None else (mark["file"], mark["pos"]) if mark is not None else ("", 0)
        bucket = F.pmod(F.xxhash64("key"), F.lit(len(at_now)).cast("long"))
        touched = {r["b"] for r in replay.operations(ready).select(bucket.alias("b")).distinct().collect()}  # at most as many as buckets
        if touched:
            ops = replay.operations(ready, self._rows(mark, touched))
            replay.keyed(ops).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{version}")
        for b in touched:
            where, fs = self._fs(f"rows/{version}/bucket={b}")
            at_now[b] = version if fs.exists(where) else -1
        if open_ is not None:
            todo.where(F.col("txn") >= open_).write.mode("overwrite").parquet(f"{self.path}/unfinished/{version}")
        self.spark.createDataFrame([(version, file, pos, at_now)], MARK).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        todo.unpersist()
        self._tidy()

    def _tidy(self) -> None:
        """Deletes the folders of the version that has just gone out of those kept, unless one of these still names them."""
        marks = self._marks()
        if len(marks) <= self.kept:
            return
        old, stay = marks[self.kept], marks[: self.kept]
        needed = {(b, v) for m in stay for b, v in enumerate(m["buckets"])}
        gone = [f"rows/{v}/bucket={b}" for b, v in enumerate(old["buckets"]) if v >= 0 and (b, v) not in needed]
        for part in [*gone, f"unfinished/{old['version']}"]:
            where, fs = self._fs(part)
            fs.delete(where, True)


def run_available(log: DataFrame, table: AppliedTable, checkpoint: str) -> None:
    """Applies all that the streaming frame has now, then stops."""
    query = log.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def with_txn_sizes(log: DataFrame) -> DataFrame:
    """A batch change log as the stream's rows."""
    sizes = log.groupBy("txn").agg(F.count("*").alias("txn_rows"))
    return log.join(sizes, "txn").select(*[c.split()[0] for c in LOG.split(", ")])


def replayed(spark: SparkSession, log: DataFrame) -> DataFrame:
    """The table that a change log leaves, applied as a stream of files in a folder shared by the cluster."""
    path = shared_folder(spark, "stream")
    with_txn_sizes(log).write.parquet(f"{path}/log")
    table = AppliedTable(spark, f"{path}/table")
    run_available(spark.readStream.schema(LOG).parquet(f"{path}/log"), table, f"{path}/checkpoint")
    return table.rows()
