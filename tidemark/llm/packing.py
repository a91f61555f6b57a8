"""Packing of documents into sequences of a fixed capacity, by bin completion with branch and bound.

What a packing costs depends on how many pieces there are of each length, not on which they are, so the search runs on a
histogram of at most `capacity` numbers, whatever the size of the corpus. The first incumbent is best fit decreasing. A node
takes the largest length left, enumerates the fillings of the rest of its bin that no other filling dominates, of any number
of items, fullest first, and applies one as often as the counts allow; a branch is dropped as soon as the bins used, with
the least that is left needs, cannot beat the incumbent; the search ends at the waste bound or after NODES nodes.
The answer is a list of patterns with multiplicities. Pieces are then numbered within their length, bucket by bucket, and
each number is looked up in the patterns: no task sees all pieces of a length.

Defined cases: null or empty text is a document of the end id alone; a document longer than the capacity is cut so that
only its first piece is shorter than the capacity; repeated rows are packed one by one; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, staged, utf8
from .tokens import ids_of

CAPACITY = 1024
#: Nodes of the search, and fillings looked at in one node, after which the incumbent or what is found stands.
NODES, STEPS = 2000, 500
#: Fillings tried at a node.
BRANCHES = 8
#: Pieces numbered by one window group, about.
BUCKET = 1000

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # (bins, ((length, times in a bin), ...))


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that the counts can need (the bound L2 of Martello and Toth, over all thresholds)."""
    n = counts.astype(np.int64)
    size = np.arange(capacity + 1)
    number, total = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        above = number[-1] - number[capacity - k]
        large, large_sum = number[capacity - k] - number[half], total[capacity - k] - total[half]
        small_sum = total[half] - (total[k - 1] if k else 0)
        best = max(best, int(above + large + max(0, -(-(small_sum - (large * capacity - large_sum)) // capacity))))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be put into those of a (each at most one step of first fit: sufficient, not necessary)."""
    room = list(a)
    for x in b:
        for k, r in enumerate(room):
            if x <= r:
                room[k] -= x
                break
        else:
            return False
    return True


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of room with the items left, of any number of items, fullest first; items descending."""
    there = [a for a in np.flatnonzero(counts[: room + 1]).tolist() if a]
    number = [min(int(counts[a]), room // a) for a in there]
    mask = (1 << (room + 1)) - 1
    reach = [1]  # bit t of reach[k]: some of the k least lengths add up to t
    for a, n in zip(there, number, strict=True):
        bits, k = reach[-1], 1
        while n:
            k = min(k, n)
            bits |= bits << a * k & mask
            n, k = n - k, 2 * k
        reach.append(bits)

    def exact(target: int, k: int):
        if not target:
            yield ()
        while target and k and reach[k] >> target & 1:
            k -= 1
            for n in range(min(number[k], target // there[k]), 0, -1):
                if reach[k] >> (target - n * there[k]) & 1:
                    for rest in exact(target - n * there[k], k):
                        yield (there[k],) * n + rest

    found: list[tuple[int, ...]] = []
    steps = 0
    for target in range(room, 0, -1):
        if not reach[-1] >> target & 1:
            continue
        for f in exact(target, len(there)):
            steps += 1
            if not any(_dominates(g, f) for g in found):
                found.append(f)
                yield f
            if len(found) >= BRANCHES or steps > STEPS:
                return
    if not found:
        yield ()


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Every piece, longest first, in the fullest bin that holds it; bins alike are filled together."""
    rooms: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # (bins, items) by the room left
    for a in np.flatnonzero(counts).tolist()[::-1]:
        left = int(counts[a])
        for room in range(a, capacity + 1):
            if not left:
                break
            times, stay = room // a, []
            for bins, items in rooms[room]:
                n = min(bins, left // times)
                if n:
                    rooms[room - times * a].append((n, (*items, (a, times))))
                    left -= n * times
                if n < bins and left and left < times:
                    rooms[room - left * a].append((1, (*items, (a, left))))
                    n, left = n + 1, 0
                if n < bins:
                    stay.append((bins - n, items))
            rooms[room] = stay
        times = capacity // a
        if left // times:
            rooms[capacity - times * a].append((left // times, ((a, times),)))
        if left % times:
            rooms[capacity - left % times * a].append((1, ((a, left % times),)))
    return [x for room in rooms for x in room]


def pack_counts(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], int]:
    """(patterns, lower bound) for counts[length] pieces of each length up to capacity."""
    counts = counts.astype(np.int64).copy()
    bound = waste_bound(counts, capacity)
    whole = int(counts[capacity])
    done: list[Pattern] = [(whole, ((capacity, 1),))] if whole else []
    counts[capacity] = 0
    first_fit = best_fit_decreasing(counts, capacity)
    best: list = [first_fit, whole + sum(n for n, _ in first_fit)]
    # A stack of (depth of path, counts, bins so far, fillings not yet tried); path holds the patterns applied.
    path: list[Pattern] = []
    stack: list = []
    nodes = 0

    def open_node(left: np.ndarray, bins: int) -> None:
        some = np.flatnonzero(left)
        if not len(some):
            if bins < best[1]:
                best[:] = [list(path), bins]
            stack.append((left, bins, 0, iter(())))
            return
        first = int(some[-1])
        rest = left.copy()
        rest[first] -= 1
        stack.append((left, bins, first, fillings(rest, capacity - first)))

    open_node(counts, whole)
    while stack:
        left, bins, first, more = stack[-1]
        fill = next(more, None)
        if fill is None or best[1] <= bound or nodes >= NODES:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes += 1
        items, times = np.unique((first, *fill), return_counts=True)
        n = int((left[items] // times).min())
        after = left.copy()
        after[items] -= times * n
        remaining = int((after * np.arange(len(after))).sum())
        if bins + n - (-remaining // capacity) >= best[1]:
            continue
        path.append((n, tuple(zip(items.tolist(), times.tolist(), strict=True))))
        open_node(after, bins + n)
    return done + best[0], bound


class Slots:
    """Number of a piece within its length -> (sequence, offset)."""

    def __init__(self, patterns: list[Pattern]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for bins, items in patterns:
            offset = 0
            for length, times in sorted(items, reverse=True):
                first = used.get(length, 0)
                rows.append((length, first, sequence, times, offset))
                used[length] = first + bins * times
                offset += length * times
            sequence += bins
        rows.sort()
        self.length, self.first, self.sequence, self.times, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 40) + self.first, (length << 40) + number, "right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.times[at], self.offset[at] + within % self.times[at] * length


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        encode = ids_of(vocabulary_path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").fill_null("")
            for a, b in chunks(offsets):
                out: list[tuple] = []
                for doc, text in zip(doc_ids[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    at, to = 0, (len(ids) - 1) % capacity + 1
                    piece = 0
                    while at < len(ids):
                        part = ids[at:to].tobytes()
                        out.append((doc, piece, at, to - at, zlib.crc32(part), part if with_ids else None))
                        at, to, piece = to, to + capacity, piece + 1
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names[:n])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces with sequence_id and offset: where each piece stands."""
    cut, _ = staged(pieces(docs, vocabulary_path, end_id, capacity, with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[row["length"]] = row["count"]
    patterns, _ = pack_counts(counts, capacity)
    slots = docs.sparkSession.sparkContext.broadcast(Slots(patterns))

    buckets = 1 + int(counts.max()) // BUCKET
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(own)).join(base, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("base") - 1)
    names = cut.columns

    def place(batches):
        for batch in batches:
            sequence, offset = slots.value.place(batch.column("length").to_numpy().astype(np.int64), batch.column("number").to_numpy())
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = _PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return numbered.select(*names, "number").mapInArrow(place, schema)
