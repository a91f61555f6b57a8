"""Removal of repeated passages, by word windows, with a count-min prefilter.

1. Every partition sketches the cores of its windows: a few words that all windows around them share, the same for equal
   windows. The merged sketch overestimates how often a core, and so a window, occurs (llm/sketch.py).
2. Only windows estimated repeated are grouped, by a 128-bit BLAKE2b digest of their words: the first occurrence by
   (doc_id, start) owns the window. A partition sends each window once, its own first, so a window that is in a
   third of all documents costs a row per partition, not per document.
3. Owners go back to their documents. A window estimated repeated whose occurrence is no owner starts earlier elsewhere,
   and its words go; a window that only looked repeated owns itself and stays.

Defined cases: null or empty text has no words; rows without a doc_id come before all others, each a document of its own;
rows that share a doc_id and the text are judged as one document (a window is one occurrence, and both keep it), unlike
texts under one doc_id as two, in an order fixed by their digests; a document of fewer words than a window loses nothing;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Words, chunks, ids, keyed, shard_count, text_bytes, utf8

WINDOW = 20
_PART = "shard int, high binary, low binary, doc binary, start binary"
_PART_ARROW = pa.schema([("shard", pa.int32())] + [(c, pa.binary()) for c in ("high", "low", "doc", "start")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, int]]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        docs = ids(batch.column("key"))
        for a, b in chunks(offsets):
            part = offsets[a : b + 1]
            yield Words(data[part[0] : part[-1]], part - part[0]), docs[a:b], a


def _split(shards: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch | None:
    """One row of packed arrays for each shard that has any."""
    if not len(shards):
        return None
    order = np.argsort(shards, kind="stable")
    shards, columns = shards[order], [c[order] for c in columns]
    heads = np.flatnonzero(np.diff(shards, prepend=-1))
    ends = np.append(heads[1:], len(shards))
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(shards[heads].astype(np.int32)), *packed], schema=schema)


def _firsts(high, low, doc, start) -> np.ndarray:
    """Indices of the earliest occurrence of each digest (high, low)."""
    order = np.lexsort((start, doc, low, high))
    h, w = high[order], low[order]
    head = np.ones(len(order), bool)
    head[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order[head]


def owners(docs: DataFrame, repeated, window: int, shards: int) -> DataFrame:
    """(doc, at): for each document, as packed int32, the starts of the windows estimated repeated that it owns."""

    def send(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            own = np.sort(_firsts(*columns))
            columns = [c[own] for c in columns]
            return _split((columns[0] % np.uint64(shards)).astype(np.int64), columns, _PART_ARROW)

        for words, doc_ids, _ in _runs(batches):
            at, core, key = words.cores(window)
            at = at[repeated.value.may_repeat(key)[core]]
            doc = words.doc[at]
            held.append((*words.digests(at, window), doc_ids[doc], (at - words.begin[doc]).astype(np.int32)))
            n += len(at)
            if n >= sketch.FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def own(group: pa.Table) -> pa.Table:
        high, low, doc, start = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("high", np.uint64), ("low", np.uint64), ("doc", np.int64), ("start", np.int32)))
        first = _firsts(high, low, doc, start)
        doc, start = doc[first], start[first]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        schema = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("start", pa.binary())])
        bucket = ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
        return pa.Table.from_batches([_split(bucket.astype(np.int64), [doc, start], schema)])

    def gather(group: pa.Table) -> pa.Table:
        doc, start = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("doc", np.int64), ("start", np.int32)))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ends = np.append(heads[1:], len(doc))
        return pa.table({"owner": pa.array(doc[heads]), "at": pa.array([start[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary())})

    sent = docs.mapInArrow(send, _PART)
    owned = sent.groupBy("shard").applyInArrow(own, "bucket int, doc binary, start binary")
    return owned.groupBy("bucket").applyInArrow(gather, "owner long, at binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, kept_text (kept words joined by one space), n_words, n_removed; with carry, also
    text and row: text and a struct of the other columns of docs as they were."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*others) if carry else F.lit(None).cast("struct<x:int>")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    docs = keyed(docs)
    size = text_bytes(docs)

    def keys(batches):
        for words, _, _ in _runs(batches):
            yield words.cores(window)[2]

    repeated = sketch.merged(docs.select("key", "text"), keys, sketch.width(size // (2 * window)))
    owned = owners(docs.select("key", "text"), repeated, window, shard_count(size))
    joined = docs.join(owned, F.col("key") == F.col("owner"), "left").select("doc_id", "key", "text", "at", "row")

    back = ["text", "row"] if carry else []

    def cut(batches):
        for batch in batches:
            owner_data, owner_offsets = utf8(batch.column("at"))
            for words, _, a in _runs(iter([batch])):
                n, docs_here = len(words.start), words.n_docs
                at, core, key = words.cores(window)
                gone = np.zeros(n + 1, bool)
                gone[at[repeated.value.may_repeat(key)[core]]] = True
                part = owner_offsets[a : a + docs_here + 1]
                starts = owner_data[part[0] : part[-1]].view(np.int32).astype(np.int64)
                gone[starts + np.repeat(words.begin[:-1], np.diff(part) // 4)] = False
                edge = np.zeros(n + window + 1, np.int32)
                hit = np.flatnonzero(gone)
                edge[hit] += 1
                edge[hit + window] -= 1
                covered = np.cumsum(edge)[:n] > 0
                lost = np.add.reduceat(np.append(covered, False).astype(np.int64), words.begin[:-1]) * (np.diff(words.begin) > 0)
                text = words.data.tobytes()
                kept = []
                for k in range(docs_here):
                    lo, hi = words.begin[k], words.begin[k + 1]
                    if lo == hi:
                        kept.append(b"")
                    elif not lost[k]:
                        kept.append(b" ".join(text[words.start[lo] : words.end[hi - 1]].split()))
                    else:
                        stay = np.flatnonzero(~covered[lo:hi]) + lo
                        kept.append(b" ".join([text[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, docs_here), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(words.begin)), pa.array(lost), *[batch.column(c).slice(a, docs_here) for c in back]], ["doc_id", "kept_text", "n_words", "n_removed", *back])

    kind = docs.schema["row"].dataType.simpleString()
    return joined.mapInArrow(cut, "doc_id long, kept_text string, n_words long, n_removed long" + (f", text string, row {kind}" if carry else ""))
