"""Session helpers: shipping this package to the Python workers of a cluster, folders that its machines share."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch. Spark's defaults (10,000 rows, 64 MB) are too much for whole documents: a batch is held
#: several times over, on both sides of the pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Arrow functions can import it there, and bounds batches."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    if getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    where = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    where.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(where))
    spark.sparkContext._tidemark_shipped = True


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the one that the cluster names in spark.checkpoint.dir. Only where that is unset and Spark runs
    on one machine, it is below a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{named.rstrip('/')}/tidemark-{kind}/{uuid.uuid4().hex}"
