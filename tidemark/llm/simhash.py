"""Near-duplicate documents by SimHash, with a Gray-order hierarchical index.

Fingerprints are made once per document and reduced to the distinct ones. Two fingerprints that differ in at most
`distance` of 64 bits agree on some choice of m - distance out of m bit blocks; m grows with the number of fingerprints
so that a bucket (one choice, one value) stays small. A bucket that is large all the same is dealt out again by blocks of
its remaining bits, after which it cannot hold more than the few values that those bits leave. Inside a bucket the
fingerprints stand in Gray-code order, upper nodes hold the bits that all their members share, and a descent adds up the
differences on those bits and drops a whole node as soon as they exceed the distance. A bucket returns a spanning forest
of its links, not its pairs; components of all links follow (llm/components.py).

Defined cases: null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle make
one shingle; repeated rows are rows of one class; a null doc_id is never a component id unless its component has no other;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, staged, utf8
from .components import components

SEED = 42
#: Entries of a bucket from which it is dealt out again.
HOT = 4096
#: Children of an index node.
FAN = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of words of the text, A-Z lower-cased, joined by one space."""
    parts = text.translate(_LOWER).split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    start = [0]
    for p in parts:
        start.append(start[-1] + len(p) + 1)
    return [digest(joined[a : b - 1], SEED) for a, b in zip(start, start[words:], strict=False)]


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (signed 64 bits): a bit is 1 if it is set in over half of the document's shingle hashes."""

    def make(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            fps = np.zeros(len(offsets) - 1, np.uint64)
            for a, b in chunks(offsets):
                hashes, begin = [], []
                for k in range(a, b):
                    begin.append(len(hashes))
                    hashes += shingle_hashes(data[offsets[k] : offsets[k + 1]].tobytes(), words)
                if hashes:
                    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    begin = np.array([*begin, len(hashes)])
                    some = np.flatnonzero(np.diff(begin))
                    counts = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
                    over = counts * 2 > np.diff(begin)[some][:, None]
                    fps[a + some] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the binary reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


#: Differences computed at once in a descent (memory: some 40 bytes each).
FRONTIER = 1 << 21


def linked_pairs(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all i < j with at most distance differing bits; fps (uint64, of one or more words each) in Gray order.

    Every level keeps, for a node, the bits that all its members share and that its parent does not know of yet. A descent
    adds up the differences level by level and leaves a node, with all below it, once they exceed the distance.
    """
    fps = fps.reshape(len(fps), -1)
    levels = [(fps, np.full(fps.shape, ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        edge = np.arange(0, len(pattern), FAN)
        every, some = np.bitwise_and.reduceat(pattern, edge), np.bitwise_or.reduceat(pattern, edge)
        levels.append((every, ~(every ^ some) & np.bitwise_and.reduceat(mask, edge)))
    news = [mask & ~levels[k + 1][1][np.arange(len(mask)) // FAN] if k + 1 < len(levels) else mask for k, (_, mask) in enumerate(levels)]
    top = len(levels[-1][0])
    step = max(1, FRONTIER // (len(fps) * fps.shape[1]))
    for at in range(0, len(fps), step):  # queries in blocks: bounded frontier
        who = np.arange(at, min(at + step, len(fps)))
        q, node = np.repeat(who, top), np.tile(np.arange(top), len(who))
        apart = np.zeros(len(q), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            later = (node + 1) * FAN**depth > q  # each pair once
            q, node, apart = q[later], node[later], apart[later]
            apart = apart + np.bitwise_count((fps[q] ^ levels[depth][0][node]) & news[depth][node]).sum(axis=1, dtype=np.int64)
            near = apart <= distance
            q, node, apart = q[near], node[near], apart[near]
            if depth:
                q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(levels[depth - 1][0])
                q, node, apart = q[there], node[there], apart[there]
        pair = node > q
        yield q[pair], node[pair]


def spanning(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component under all pairs of the blocks, one block at a time."""
    root = np.arange(n)
    for a, b in blocks:
        if len(a):
            root = forest(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root]))
    return root


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(low: int, high: int, n: int) -> list[int]:
    """Masks that cut bits [low, high) into n blocks."""
    edges = [low + (high - low) * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _choices(bits: int, n_blocks: int, distance: int) -> list[int]:
    """Masks over [0, bits): every choice of n_blocks - distance of n_blocks blocks."""
    cut = _blocks(0, bits, n_blocks)
    return [sum(c) for c in combinations(cut, n_blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refined(mask: int, distance: int) -> list[int]:
    """Masks that extend mask by a choice of blocks of the bits that it leaves free."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    n = distance + 2
    cut = [sum(free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
    return [mask | sum(c) for c in combinations(cut, n - distance)]


def links(distinct: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of all pairs of distinct.fp within distance."""
    n = distinct.count()
    blocks = distance + 1
    while blocks < distance + 6 and n >> (64 * (blocks - distance) // blocks) > hot // 16:
        blocks += 1
    masks = _choices(64, blocks, distance)

    def keyed(df: DataFrame, choices: list[tuple[int, int]]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value")) for k, m in choices])
        return df.select("fp", F.explode(pairs).alias("key")).select("fp", "key.choice", "key.value")

    dealt = keyed(distinct, list(enumerate(masks)))
    sizes = dealt.groupBy("choice", "value").agg(F.count("*").alias("n"))
    large, _ = staged(sizes.where(F.col("n") > hot).select("choice", "value"))
    usual, again = dealt, None
    if not large.isEmpty():
        usual = dealt.join(large, ["choice", "value"], "left_anti")
        again = dealt.join(large, ["choice", "value"], "left_semi")
        parts = []
        for k, m in enumerate(masks):
            finer = [(len(masks) * (k + 1) + j, x) for j, x in enumerate(_refined(m, distance))]
            parts.append(keyed(again.where(F.col("choice") == k).select("fp"), finer))
        for p in parts:
            usual = usual.unionByName(p)

    def join(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if len(fp) < 2:
            return none
        fp = fp[np.argsort(gray_rank(fp), kind="stable")]
        root = spanning(len(fp), linked_pairs(fp, distance))
        child = np.flatnonzero(root != np.arange(len(fp)))
        fp = fp.view(np.int64)
        return pa.table({"u": pa.array(fp[child]), "v": pa.array(fp[root[child]])})

    def join_all(batches):
        """Buckets of one partition, sorted by bucket: a Python call per bucket only where it has more than one value."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            choice, value = t["choice"].to_numpy(), t["value"].to_numpy()
            heads = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (value[1:] != value[:-1])))
            rest = t.slice(int(heads[-1]))  # the last bucket may go on
            yield from _buckets(t, heads, join)
        if rest is not None and rest.num_rows > 1:
            yield from join(rest).to_batches()

    return usual.repartition("choice", "value").sortWithinPartitions("choice", "value").mapInArrow(join_all, "u long, v long")


def _buckets(t: pa.Table, heads: np.ndarray, join):
    ends = heads[1:]
    for a, b in zip(heads[:-1], ends, strict=True):
        if b - a > 1:
            out = join(t.slice(int(a), int(b - a)))
            if out.num_rows:
                yield from out.to_batches()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links)."""
    fps, _ = staged(fingerprints(docs, words))
    distinct, _ = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select("fp"), distance))
    # Few fingerprints have a link; the others are their own component.
    member = distinct.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = staged(member.join(least, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
