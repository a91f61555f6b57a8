"""Tables published whole: written to a folder of their own, then named by a mark; older versions stay as backups for a while."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "version long, folder string"


class PublishedTable:
    """A version counts once its mark is written, so a load that fails halfway or runs again changes nothing that is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list:
        """Marks, newest first: as many as versions were published."""
        where, fs = self._fs(f"{self.path}/marks")
        return self.spark.read.schema(MARK).parquet(f"{self.path}/marks").orderBy(F.desc("version")).collect() if fs.exists(where) else []

    def read(self) -> DataFrame | None:
        marks = self.versions()
        return self.spark.read.parquet(f"{self.path}/{marks[0]['folder']}") if marks else None

    def publish(self, rows: DataFrame, backups: int = 1) -> None:
        """Makes rows the table; keeps the newest `backups` versions before it (below 0: 1)."""
        marks = self.versions()
        folder = f"staging-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        mark = (marks[0]["version"] + 1 if marks else 0, folder)
        self.spark.createDataFrame([mark], MARK).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        for old in marks[backups if backups >= 0 else 1 :]:
            where, fs = self._fs(f"{self.path}/{old['folder']}")
            fs.delete(where, True)
