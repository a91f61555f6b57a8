"""Helpers shared by the training-data operators: flat views of Arrow text, word hashes, stage tables."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: Text bytes handled at once by the vectorised kernels; a longer document is handled alone.
CHUNK_BYTES = 1 << 21
#: Stands for a null doc_id where documents are ordered: before every other id.
NULL_ID = -(1 << 63)

_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stage tables

_STAGES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not getattr(spark, "_tidemark_dir", None):
        spark._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return spark._tidemark_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _STAGES:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder is the cluster's to clean
            return


#: Shuffle files go when the query that made them has ended, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, free: bool = False) -> tuple[DataFrame, str]:
    """Writes df once to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation.
    free: df's shuffle files are deleted as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-stages/{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _STAGES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Deletes a stage table that nothing reads any more."""
    _delete(spark, path)
    _STAGES[:] = [x for x in _STAGES if x[1] != path]


def stage_paths() -> set[str]:
    return {p for _, p in _STAGES}


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one column-pruned JVM scan, used to size sketches and shard counts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def shard_count(n_bytes: int, per_shard: int = 4 << 20, least: int = 32) -> int:
    return max(least, -(-n_bytes // per_shard))


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text, ...) and key, a long that tells documents apart and orders them by doc_id, null first.

    Rows that share a doc_id and the text have one key; those that share an id only, and rows without one, have keys of
    their own. Where no id is shared the key is the id; else all rows are numbered in order, and staged.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    order = ["doc_id", "__a", "__b", "__alone"]
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    marked = docs.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text"), "__alone": alone})
    numbered = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    return staged(numbered.withColumn("key", F.min("key").over(Window.partitionBy(*order))).select(*docs.columns, "key"))[0]


# ---------------------------------------------------------------- flat Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy of the text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column: pa.Array) -> np.ndarray:
    """int64 ids; null as NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


# ---------------------------------------------------------------- hashing


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), _U64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b, as two words, of data[start:end]: what equality of content is decided by."""
    view, make = memoryview(data), hashlib.blake2b
    flat = b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(flat, _U64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i that has them all (two running minima, one from each block's ends)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Poly:
    """Polynomial hashes modulo 2**64: a random 64-bit value per byte, an odd base.

    Made to collide with ease (words over two letters after Thue and Morse do, whatever the base), so they only choose the
    cells of sketches, where a collision costs time; equality is decided by `digests`.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.bytes = draw.integers(0, 1 << 64, 256, dtype=_U64)
        self.base = int(draw.integers(0, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = powers(self.base, 1)

    def up(self, n: int) -> np.ndarray:
        if len(self._up) < n:
            self._up = powers(self.base, n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        if len(self._down) < n:
            self._down = powers(self.inverse, n)
        return self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Running sums of value * base**position, one longer than values."""
        out = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * self.up(len(values)), out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever the span stands."""
        return fmix((prefix[end] - prefix[start]) * self.down(len(prefix))[start])


POLY = Poly(11)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a run of documents: starts, ends, document of each, a 64-bit hash for sketches."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, poly: Poly = POLY):
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        solid = ~blank
        first = solid.copy()
        first[1:] &= blank[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = solid[edges]
        last = solid.copy()
        last[:-1] &= blank[1:]
        edges = offsets[1:] - 1
        edges = edges[edges >= 0]
        last[edges] = solid[edges]
        self.data, self.n_docs = data, len(offsets) - 1
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.begin = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # first word of each document
        self.poly, self.hash = poly, np.zeros(0, _U64)
        if len(self.start):
            size = self.end - self.start
            at = np.flatnonzero(solid)
            edge = np.cumsum(size) - size
            local = at - np.repeat(self.start, size)
            byte = data[at]
            longest = int(size.max())
            self.hash = fmix(np.add.reduceat(poly.bytes[byte] * poly.up(longest)[local], edge) + size.astype(_U64))

    def cores(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first word, number of the core, hashes of the cores) of every run of length words.

        A run's core begins where the least word hash of its first half stands (leftmost on ties) and is as long as the rest
        of the run allows anywhere: equal runs have equal cores, at places of their own, and neighbours share theirs.
        """
        reach = max(1, length // 2)
        n = len(self.start)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U64)
        at = np.flatnonzero(self.doc[length - 1 :] == self.doc[: n - length + 1])
        rank = fmix(self.hash) & _U64(0xFFFFFFFF00000000) | np.arange(n, dtype=_U64)
        place = (least_of(rank, reach)[at] & _U64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        place = place[new]
        return at, np.cumsum(new) - 1, self.poly.spans(self.poly.prefix(self.hash), place, place + length - reach + 1)

    def digests(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the runs of length words from each of at on: of the words joined by one space, so of the words themselves."""
        size = self.end - self.start
        begin = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        joined[begin[word] + local] = self.data[self.start[word] + local]
        return digests(joined.tobytes(), begin[at], begin[at + length - 1] + size[at + length - 1])
