"""Token-id files: canonical length-limited Huffman codes of ids, in independent blocks with bit-offset checkpoints.

A written folder holds `codes` (id, bits: the length of its code; codes are canonical, so lengths say all) and `blocks`.
A block is a row: the doc_ids and numbers of ids of its documents, their ids as one bit string, the bit offset of every
LANE-th id, and where the block stands. Blocks are of whole documents in ascending doc_id order and decode independently:
all lanes of a block step together through one table that the next BITS bits index. Blocks are written by Spark's own
Parquet writer, so that any store will do and a task that is lost or runs twice leaves one copy.

Global order is that of a range partitioning of the texts by (doc_id, digest of the text), so that even rows of one doc_id are
dealt to many tasks; each task sorts, encodes and numbers its own range.

Defined cases: null or empty text is the end id alone; a null doc_id comes first; rows that share a doc_id follow one
another, by a digest of their texts; further columns are ignored; an empty table writes no blocks and reads back as no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, drop_stage, ids, shared_dir, staged, text_bytes, utf8
from .tokens import ids_of

#: Longest code, in bits; at least 16 for vocabularies of up to 65,536 ids, at most 24 (a lane peeks at 32 bits).
BITS = 20
#: Ids between checkpoints, and ids after which a block ends with its document.
LANE, BLOCK = 64, 1 << 18
#: Bytes of text in a range, about, and most ranges.
RANGE, MOST_RANGES = 8 << 20, 1 << 16


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge, Larmore and Hirschberg 1990); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # of each list, whether an entry is a leaf, in order of weight
    now, leaf = weight, np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weight, pairs])
        sort = np.argsort(every, kind="stable")
        now, leaf = every[sort], sort < n
    levels.append(leaf)
    take = 2 * n - 2
    for leaf in reversed(levels):  # of the take first entries, leaves gain a bit and packages open
        leaves = int(leaf[:take].sum())
        bits[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each id: counted up in order of (length, id)."""
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    size = bits[order]
    width = int(size.max(initial=1))
    step = np.left_shift(1, width - size)
    at = np.cumsum(step) - step
    codes = np.zeros(len(bits), np.int64)
    codes[order] = at >> (width - size)
    return codes


class Decoder:
    def __init__(self, bits: np.ndarray):
        used = np.flatnonzero(bits)
        order = used[np.lexsort((used, bits[used]))]
        self.width = int(bits.max(initial=1))
        times = np.left_shift(1, self.width - bits[order])
        self.ids = np.zeros(1 << self.width, np.uint32)
        self.bits = np.ones(1 << self.width, np.uint8)
        filled = int(times.sum())
        self.ids[:filled] = np.repeat(order, times)
        self.bits[:filled] = np.repeat(bits[order], times)

    def decode(self, packed: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """n ids from a bit string whose every LANE-th id begins at a mark."""
        data = np.frombuffer(packed + bytes(8), np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        at = marks.astype(np.int64)
        last = (len(window) - 1) * 8
        out = np.empty((len(marks), LANE), np.uint32)
        mask = np.uint32((1 << self.width) - 1)
        for k in range(LANE):
            peek = window[at >> 3] >> (32 - self.width - (at & 7)).astype(np.uint32) & mask
            out[:, k] = self.ids[peek]
            at = np.minimum(at + self.bits[peek], last)  # the last lane may run past its end
        return out.ravel()[:n]


def pack_bits(codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(codes one after the other, most significant bit first; bit offset of every LANE-th)."""
    end = np.cumsum(bits)
    start = end - bits
    word, shift = start >> 6, 64 - (start & 63) - bits
    value = codes.astype(np.uint64)
    fits = shift >= 0
    here = np.where(fits, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    words = np.zeros(int(end[-1] + 63) // 64 + 1, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.add.reduceat(here, heads)  # codes do not overlap: their sum is their union
    over = np.flatnonzero(~fits)
    words[word[over] + 1] += value[over] << (64 + shift[over]).astype(np.uint64)
    return words.byteswap().tobytes()[: int(end[-1] + 7) // 8], start[::LANE].astype(np.uint32)


# ---------------------------------------------------------------- writing


def _staged_ids(docs: DataFrame, vocabulary_path: str, end_id: int) -> tuple[DataFrame, str]:
    """range, doc_id, ids (unsigned 16 or 32 bits), each range in one file in ascending order."""
    n = min(MOST_RANGES, 1 + text_bytes(docs) // RANGE)
    order = ["doc_id", "digest"]

    def run(batches):
        range_ = TaskContext.get().partitionId()
        encode = ids_of(vocabulary_path)
        kind = "<u2" if encode.size <= 1 << 16 else "<u4"
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts = batch.column("text").fill_null("")
            for a, b in chunks(offsets):
                packed = [np.append(encode(t), np.uint32(end_id)).astype(kind).tobytes() for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, range_, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(packed, pa.binary())], ["range", "doc_id", "ids"])

    dealt = docs.withColumn("digest", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(dealt.select("doc_id", "text").mapInArrow(run, "range int, doc_id long, ids binary"))


def _counts(stage: DataFrame, size: int) -> np.ndarray:
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = utf8(batch.column("ids"))
            n += np.bincount(data.view(kind), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in stage.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row an id
        out[row["id"]] = row["n"]
    return out


_BLOCKS = "range int, first_doc long, last_doc long, n_ids long, doc_ids binary, lengths binary, bits binary, marks binary"


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, path: str | None = None) -> str:
    """Writes the ids of all documents, each with end_id, and returns the folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = path or f"{shared_dir(spark)}/tidemark-tokens/{uuid.uuid4().hex}"
    stage, stage_path = _staged_ids(docs, vocabulary_path, end_id)
    size = ids_of(vocabulary_path).size
    bits = code_lengths(_counts(stage, size))
    kind = "<u2" if size <= 1 << 16 else "<u4"
    used = np.flatnonzero(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    held = spark.sparkContext.broadcast((canonical(bits).astype(np.uint32), bits.astype(np.uint8)))

    def blocks(batches):
        codes, widths = held.value
        docs_, parts, now, n = [], [], None, 0

        def close():
            flat = np.concatenate(parts)
            packed, marks = pack_bits(codes[flat], widths[flat].astype(np.int64))
            lengths = np.array([len(p) for p in parts], "<u4")
            row = [now, docs_[0], docs_[-1], len(flat), np.array(docs_, "<i8").tobytes(), lengths.tobytes(), packed, marks.astype("<u4").tobytes()]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            data, offsets = utf8(batch.column("ids"))
            for range_, doc, a, b in zip(batch.column("range").to_pylist(), ids(batch.column("doc_id")).tolist(), offsets, offsets[1:], strict=False):
                if parts and (range_ != now or doc < docs_[-1] or n >= BLOCK):
                    yield close()
                    docs_, parts, n = [], [], 0
                now = range_
                docs_.append(doc)
                parts.append(data[a:b].view(kind))
                n += len(parts[-1])
        if parts:
            yield close()

    stage.mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_stage(spark, stage_path)
    return path


# ---------------------------------------------------------------- reading


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of a written folder."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/codes").collect()  # at most one row an id
    bits = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        bits[r["id"]] = r["bits"]
    held = spark.sparkContext.broadcast(Decoder(bits))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    place = blocks.select("range", "first_doc", "last_doc", "n_ids", F.crc32("bits").alias("sum"))
    totals = {r["range"]: r["n"] for r in place.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}  # at most MOST_RANGES
    base, at = [], 0
    for k in sorted(totals):
        base.append((k, at))
        at += totals[k]
    base = spark.createDataFrame(base, "range int, base long")
    order = Window.partitionBy("range").orderBy("first_doc", "last_doc", "sum").rowsBetween(Window.unboundedPreceding, -1)
    placed = place.select("range", "first_doc", "last_doc", "sum", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("within")).join(F.broadcast(base), "range")
    keys = ["range", "first_doc", "last_doc", "sum"]
    whole = blocks.withColumn("sum", F.crc32("bits"))
    if not place.groupBy(*keys).count().where("count > 1").isEmpty():
        # Blocks that agree in all keys are copies of one another: each takes a place of its own.
        placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("within")))
        whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("n_ids")))
        keys = [*keys, "copy"]
    joined = whole.join(placed, keys).select((F.col("base") + F.col("within")).alias("start"), "n_ids", "doc_ids", "lengths", "bits", "marks")

    def decode(batches):
        decoder = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                start, n, doc_ids, lengths, packed, marks = (c[k].as_py() for c in batch.columns)
                flat = decoder.decode(packed, np.frombuffer(marks, "<u4"), n)
                doc_ids, lengths = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<u4").astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                packed_ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + offsets[:-1]), packed_ids], ["doc_id", "start", "ids"])

    return joined.mapInArrow(decode, "doc_id long, start long, ids binary")
