"""Removal of every byte covered by a long string that starts anywhere else too, by sparse suffix arrays kept in a
logarithmic index family.

Suffixes. A string of MATCH bytes is looked at where the least 8-byte gram of its first REACH positions stands (leftmost on
ties): equal strings choose the same place, its anchor. Only suffixes that belong to anchors are indexed, one in some 32.
The order of a suffix array is that of a 128-bit BLAKE2b digest of the string that a suffix begins with;
equal strings are neighbours in it, which is all that a scan for matches of at least MATCH bytes asks of the order.

Index. A task holds the suffixes of one range of digests as levels of growing size. A new batch (what some tasks sent) is
sorted into a suffix array, merge-scanned against every level, matches being marked on both sides, and pushed; two levels
of equal size are merged into one of twice the size.

Steps. (1) The family over whole anchor contexts (all strings of an anchor at once, as far as the document reaches) marks those
that repeat as a whole: within copies, that settles all strings of an anchor with one entry. Equal strings have equal cores,
the bytes that every string of an anchor holds; anchors are dealt by a hash of theirs. (2) Where anchors with one core have
several contexts, at the borders of copies, one place of each context goes string by string through the family again. An anchor
alone with its core, or with copies of its context only, has nothing more to find. A task sends each digest once and settles
its own repeats itself, so that content in a third of all documents is as many entries as tasks.

Size. (1) sends 38 bytes for each anchor, some 1.2 times the text, (2) 28 bytes for each string at a border of copies. There
is no sketch that a large table could fill.

Defined cases: null or empty text has no bytes; texts shorter than MATCH lose nothing; matches never cross documents; rows
that share a doc_id and the text are one document (an exact repeat of a whole row is not a repeat of its text), unlike
texts under one doc_id are two, and each row without a doc_id is its own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POLY, chunks, digests, fmix, ids, keyed, least_of, shard_count, staged, text_bytes, utf8

MATCH = 400
#: Positions of which a string's anchor is chosen: places that an anchor can have in a string. At most 255.
REACH = 64
_GRAM = 8
#: Entries a task gathers before it sends them.
FLUSH = 2_000_000

#: Suffixes that a batch has at least, so that their number follows the text and not the tasks that send.
BATCH = 1 << 16

_SENT = "kind int, shard int, high binary, low binary, doc binary, at binary, twice binary, n binary, core binary"
_MARKED = "kind int, bucket int, doc binary, at binary, n binary"


class Anchors:
    """Strings of length MATCH of a run of documents: where each starts, and the anchor that it belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, match: int):
        self.data, self.offsets, self.match = data, offsets, match
        self.start = np.zeros(0, np.int64)
        self.at = self.group = self.doc = self.first = self.n = self.start
        long = np.flatnonzero(np.diff(offsets) >= match)
        if not len(long):
            return
        count = np.diff(offsets)[long] - match + 1
        edge = np.cumsum(count) - count
        self.start = np.arange(int(count.sum())) + np.repeat(offsets[long] - edge, count)
        buffer = np.concatenate([data, np.zeros(_GRAM, np.uint8)])
        gram = np.ndarray(len(data), "<u8", buffer=buffer.data, strides=(1,))
        rank = (fmix(gram * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data), dtype=np.uint64)
        anchor = (least_of(rank, REACH)[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, anchor[1:] != anchor[:-1])
        self.at = anchor[new]  # ascending: a place is the anchor of one run of strings
        self.group = np.cumsum(new) - 1
        self.first = self.start[new]  # of an anchor's strings: the first one's place, and their number
        self.n = np.diff(np.append(np.flatnonzero(new), len(new)))
        self.doc = np.searchsorted(offsets, self.at, "right") - 1

    def digest(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return digests(self.data.tobytes(), start, end)

    def cores(self) -> np.ndarray:
        """Hash of the bytes that all strings of an anchor share; what repeats is decided by `digest`."""
        return POLY.spans(POLY.prefix(POLY.bytes[self.data]), self.at, self.at + self.match - REACH + 1)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the bytes that all strings of an anchor can cover within its document and of the anchor's place in them:
        anchors with equal ones have equal strings."""
        start = np.maximum(self.at - REACH + 1, self.offsets[self.doc])
        high, low = self.digest(start, np.minimum(self.at + self.match, self.offsets[self.doc + 1]))
        return high ^ fmix((self.at - start).astype(np.uint64)), low

    def places(self) -> np.ndarray:
        """Where, in its document, the first string of each anchor starts."""
        return (self.first - self.offsets[self.doc]).astype(np.int32)


def _runs(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[tuple[Anchors, np.ndarray, int]]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        docs = ids(batch.column("key"))
        for a, b in chunks(offsets):
            part = offsets[a : b + 1]
            yield Anchors(data[part[0] : part[-1]], part - part[0], match), docs[a:b], a


class Family:
    """Suffix arrays of geometrically growing size. A suffix: digest (high, low), document, place, whether it has matched, and
    further columns."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        """The merged array of two; suffixes equal to a neighbour are marked."""
        both = [np.concatenate(c) for c in zip(a, b, strict=True)]
        order = np.lexsort((both[1], both[0]))
        high, low, doc, at, hit, *more = (c[order] for c in both)
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
        hit[1:] |= same
        hit[:-1] |= same
        return high, low, doc, at, hit, *more

    def add(self, high, low, doc, at, hit, *more) -> None:
        none = tuple(c[:0] for c in (high, low, doc, at, hit, *more))
        batch = self._merge((high, low, doc, at, hit.copy(), *more), none)
        for level in self.levels:  # scan: marks on both sides
            keys = np.searchsorted(level[0], batch[0])
            near = np.flatnonzero(level[0][np.minimum(keys, len(level[0]) - 1)] == batch[0])
            if not len(near):
                continue
            own = np.flatnonzero(np.isin(level[0], batch[0][near]))
            merged = self._merge(tuple(c[own] for c in level), tuple(c[near] for c in batch))
            run = _runs_of(merged[0], merged[1])
            hit = np.bincount(run, weights=merged[4]) > 0
            head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            for array, rows in ((level, own), (batch, near)):  # rows are in the order of merged: their runs are found by a merge
                which = run[_places(merged[0][head], merged[1][head], head, array[0][rows], array[1][rows])]
                array[4][rows] |= hit[which]
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(a, b))

    def whole(self) -> tuple[np.ndarray, ...]:
        """All suffixes as one array, and a mark carried to every equal suffix."""
        out = self.levels[0]
        for level in self.levels[1:]:
            out = self._merge(out, level)
        high, low, doc, at, hit, *more = out
        run = _runs_of(high, low)
        any_hit = np.bincount(run, weights=hit) > 0
        return high, low, doc, at, any_hit[run], *more


def _runs_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The number of the run of equal digests that each suffix is in."""
    return np.cumsum(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]) - 1


def _places(high: np.ndarray, low: np.ndarray, head: np.ndarray, of_high: np.ndarray, of_low: np.ndarray) -> np.ndarray:
    """Where the run of each digest of (of_high, of_low) begins; the runs, (high, low) at head, are in order and hold them all."""
    at = np.searchsorted(high, of_high)
    while True:  # digests that agree in their high word: on to the one that agrees in both
        wrong = low[at] != of_low
        if not wrong.any():
            return head[at]
        at = at + wrong


def _packed(schema: str, kind: int, groups: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of schema: kind, group, and each of the columns as the bytes that the group has of it; other columns are null."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])[: len(groups)])
    ends = np.append(heads[1:], len(groups))[: len(heads)]
    names = [c.split()[0] for c in schema.split(", ")]
    parts = {k: pa.array([c[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()) for k, c in ((k, c[order]) for k, c in columns.items())}
    none = pa.nulls(len(heads), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), kind, np.int32)), pa.array(groups[heads]), *(parts.get(c, none) for c in names[2:])], names)


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (fmix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def repeated(docs: DataFrame, entries: Callable, shards: int) -> DataFrame:
    """All (doc, at, n) whose digest occurs at another (doc, at) too, packed by bucket of doc (kind 1). entries(batches) yields
    (high, low, doc, at) arrays and, where an entry stands for n strings from at on, their number and their core's hash; then
    kind 2 has the first place of each digest that shares its core with another digest."""

    def send(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            high, low, doc, at, *more = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((at, doc, low, high))
            high, low, doc, at, *more = (c[order] for c in (high, low, doc, at, *more))
            run = _runs_of(high, low)
            head = np.append(True, run[1:] != run[:-1])
            other = np.append(False, ~head[1:] & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))
            twice = np.bincount(run, weights=other) > 0  # settled here: all of the run repeat
            of_strings = dict(zip(("n", "core"), more, strict=False))
            shard = ((of_strings["core"] if more else high)[head] % np.uint64(shards)).astype(np.int32)
            yield _packed(_SENT, 0, shard, high=high[head], low=low[head], doc=doc[head], at=at[head], twice=twice, **{k: c[head] for k, c in of_strings.items()})
            own = other & twice[run]
            yield _packed(_SENT, 1, _bucket(doc[own], shards), doc=doc[own], at=at[own], **{"n": c[own] for c in more[:1]})

        for part in entries(batches):
            held.append(part)
            count += len(part[0])
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def index(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() == 1:
            return group.select(["kind", "shard", "doc", "at", "n"]).rename_columns(["kind", "bucket", "doc", "at", "n"])
        whole = group["core"].null_count == 0
        types = {"high": np.uint64, "low": np.uint64, "doc": np.int64, "at": np.int32, "twice": bool} | ({"n": np.uint8, "core": np.uint64} if whole else {})
        family = Family()
        parts = {c: group[c].to_pylist() for c in types}
        sizes = np.cumsum([len(x) for x in parts["twice"]])
        at = np.flatnonzero(np.diff(sizes // BATCH, append=-1)) + 1  # a batch ends with the row that fills it, and with the last
        for a, b in zip([0, *at[:-1]], at, strict=True):
            family.add(*(np.frombuffer(b"".join(parts[c][a:b]), t) for c, t in types.items()))
        high, low, doc, at, hit, *more = family.whole()
        out = [_packed(_MARKED, 1, _bucket(doc[hit], shards), doc=doc[hit], at=at[hit], **{"n": c[hit] for c in more[:1]})]
        if whole:
            order = np.lexsort((at, doc, low, high, more[1]))
            high, low, doc, at, core = (c[order] for c in (high, low, doc, at, more[1]))
            first = np.append(True, (core[1:] != core[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
            run = _runs_of(core, core)
            several = first & (np.bincount(run, weights=first) > 1)[run]
            out.append(_packed(_MARKED, 2, _bucket(doc[several], shards), doc=doc[several], at=at[several]))
        return pa.Table.from_batches(out)

    return docs.mapInArrow(send, _SENT).groupBy("kind", "shard").applyInArrow(index, _MARKED)


def _joined(group: pa.Table, *columns: str) -> list[np.ndarray]:
    """The columns of all rows of a group, in order of doc and at; a number n that is not given is 1."""
    out = [np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("doc", np.int64), ("at", np.int32))]
    if "n" in columns:
        out.append(np.frombuffer(b"".join(b"\1" * (len(at) // 4) if n is None else n for n, at in zip(group["n"].to_pylist(), group["at"].to_pylist(), strict=True)), np.uint8))
    order = np.lexsort((out[1], out[0]))
    return [c[order] for c in out]


def _by_owner(owner: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each run of equal owners, with the bytes of its columns."""
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    ends = np.append(heads[1:], len(owner))
    return pa.table({"owner": pa.array(owner[heads])} | {k: pa.array([c[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()) for k, c in columns.items()})


def marks(docs: DataFrame, match: int) -> DataFrame:
    """(owner, begin, end): for each document that has any, packed int32 begins and ends of its maximal repeated runs."""
    size = text_bytes(docs)
    shards = shard_count(size)

    def context_entries(batches):
        for a, docs_, _ in _runs(batches, match):
            if len(a.at):
                yield *a.contexts(), docs_[a.doc], a.places(), a.n.astype(np.uint8), a.cores()

    whole, _ = staged(repeated(docs, context_entries, shards), free=True)

    def place(group: pa.Table) -> pa.Table:
        doc, at = _joined(group)
        return _by_owner(doc, place=at)

    places = whole.where("kind = 2").groupBy("bucket").applyInArrow(place, "owner long, place binary")
    asked = docs.join(places, F.col("key") == F.col("owner")).select("key", "text", "place")

    def string_entries(batches):
        for batch in batches:
            data, edges = utf8(batch.column("place"))
            for a, docs_, row in _runs(iter([batch]), match):
                edge = edges[row : row + len(docs_) + 1]
                place = data[edge[0] : edge[-1]].view(np.int32) + np.repeat(a.offsets[:-1], np.diff(edge) // 4)
                own = np.flatnonzero(np.isin(a.first, place)[a.group])
                if len(own):
                    start, doc = a.start[own], a.doc[a.group[own]]
                    yield *a.digest(start, start + match), docs_[doc], (start - a.offsets[doc]).astype(np.int32)

    part, _ = staged(repeated(asked, string_entries, shards), free=True)

    def gather(group: pa.Table) -> pa.Table:
        doc, at, n = _joined(group, "n")
        base = np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 33  # documents one after another: a run never reaches the next one
        begin = base + at
        end = np.maximum.accumulate(begin + n + (match - 1))
        head = np.append(True, begin[1:] > end[:-1])
        return _by_owner(doc[head], begin=at[head], end=(end - base)[np.append(head[1:], True)].astype(np.int32))

    every = whole.where("kind = 1").unionByName(part.where("kind = 1"))
    return every.groupBy("bucket").applyInArrow(gather, "owner long, begin binary, end binary")


def remove_repeated_bytes(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """One row per row of docs: doc_id, kept (bytes that stay), n_bytes, n_removed, n_spans (maximal removed runs)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = keyed(docs)
    found = marks(docs.select("key", "text"), match)
    joined = docs.join(found, F.col("key") == F.col("owner"), "left").select("doc_id", "text", "begin", "end")

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n, size = batch.num_rows, np.diff(offsets)
            (begin, edges), (end, _) = (utf8(batch.column(c)) for c in ("begin", "end"))
            spans = np.diff(edges) // 4
            row = np.repeat(np.arange(n), spans)
            begin, end = (c.view(np.int32) + offsets[row] for c in (begin, end))
            edge = np.zeros(len(data) + 1, np.int8)  # no two runs begin, or end, at one place
            edge[begin] += 1
            edge[end] -= 1
            kept_data = data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
            removed = np.bincount(row, weights=end - begin, minlength=n).astype(np.int64)
            kept_edges = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_edges), pa.py_buffer(np.ascontiguousarray(kept_data))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept, pa.array(size), pa.array(removed), pa.array(spans)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
