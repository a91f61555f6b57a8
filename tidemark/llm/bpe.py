"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree hold, for each adjacent pair, its merge rank and place; inner nodes hold the least. The root
is the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, the one before and the one after), each
renewed along its path to the root, until the root says that no pair can be merged. Short words of a batch have their
trees side by side in arrays, so that a step of all of them is a few array operations; a long word has a tree of its own.
A word of n bytes takes O(n log n) whatever it repeats.

Defined cases: null text is empty and has no ids; a null or empty list decodes to the empty text; a text that holds an added
token's string gets that token's id there; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded one by one;
further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8
from .pretokens import CachedEncoder, Vocabulary

#: Longest word whose tree stands among others in arrays.
SIDE_BY_SIDE = 64


class SegmentTreeBpe:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        key = v.left << 32 | v.right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order, v.merged
        self.none = len(key)  # the rank of a pair that cannot be merged
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def one(self, word: bytes) -> list[int]:
        """A long word: one tree in a list."""
        ids = self.vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        width = 1 << max(0, (n - 2).bit_length())
        none, rank_of, merged = self.none * n, self.rank_of, self.merged.tolist()
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [rank_of.get(a << 32 | b, self.none) * n + k if (a << 32 | b) in rank_of else none for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        def renew(leaf: int) -> None:
            right = after[leaf]
            rank = rank_of.get(ids[leaf] << 32 | ids[right]) if right < n else None
            put(leaf, none if rank is None else rank * n + leaf)

        while tree[1] < none:
            rank, at = divmod(tree[1], n)
            gone = after[at]
            ids[at] = merged[rank]
            ids[gone] = -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            if gone < n - 1:
                put(gone, none)
            renew(at)
            if before[at] >= 0:
                renew(before[at])
        return [i for i in ids if i >= 0]

    def many(self, raw: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 2 to width bytes, width a power of two, given one after the other: their trees side by side.

        Returns all ids and the number of ids of each word. Arrays are flat: row * stride + place.
        """
        n, step, none = len(size), width + 1, self.none * width
        place = np.arange(width)
        there = place < size[:, None]
        ids = np.zeros((n, step), np.int64)
        ids[:, :width][there] = self.vocabulary.byte_ids[raw]
        tree = np.full((n, 2 * width), none, np.int64)
        pair = there[:, 1:]
        rank = self.pair_ranks(ids[:, : width - 1][pair], ids[:, 1:width][pair])
        tree[:, width : 2 * width - 1][pair] = np.where(rank < self.none, rank * width + np.broadcast_to(place[:-1], pair.shape)[pair], none)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        after = np.tile(np.arange(1, step + 1), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width), (n, 1)).ravel()
        roots, tree, ids = tree[:, 1], tree.ravel(), ids.ravel()
        alive = there.ravel().copy()
        row = np.flatnonzero(roots < none)
        while len(row):
            rank, at = np.divmod(roots[row], width)
            base = row * step
            gone = after[base + at]
            next_ = after[base + gone]
            merged = self.merged[rank]
            ids[base + at] = merged
            alive[row * width + gone] = False
            after[base + at] = next_
            before[base + next_] = at  # the last column takes what has no successor
            left = before[base + at]
            leaf = [row * 2 * width + width + gone]
            value = [np.full(len(row), none)]
            # The pair that begins here, then the pair that ends here.
            here, there_ = next_ < size[row], left >= 0
            a, b = np.flatnonzero(here), np.flatnonzero(there_)
            ranks = self.pair_ranks(np.concatenate([merged[a], ids[base[b] + left[b]]]), np.concatenate([ids[base[a] + next_[a]], merged[b]]))
            own = np.full(len(row), none)
            own[a] = np.where(ranks[: len(a)] < self.none, ranks[: len(a)] * width + at[a], none)
            leaf += [row * 2 * width + width + at, row[b] * 2 * width + width + left[b]]
            value += [own, np.where(ranks[len(a) :] < self.none, ranks[len(a) :] * width + left[b], none)]
            leaf, value = np.concatenate(leaf), np.concatenate(value)
            tree[leaf] = value
            top = np.concatenate([row, row, row[b]]) * 2 * width
            k = leaf - top
            for _ in range(width.bit_length() - 1):  # the paths to the root, all as long as one another
                k >>= 1
                low = top + 2 * k
                tree[top + k] = np.minimum(tree[low], tree[low + 1])
            row = row[roots[row] < none]
        kept = alive.reshape(n, width)
        return ids.reshape(n, step)[:, :width][kept].astype("<u4"), kept.sum(axis=1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raws = [w.encode() for w in words]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        out: list[bytes] = [b""] * len(raws)
        for k in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
            out[k] = np.array(self.one(raws[k]), "<u4").tobytes()
        single = self.vocabulary.byte_ids.astype("<u4")
        for k in np.flatnonzero(size == 1).tolist():
            out[k] = single[raws[k][0]].tobytes()
        low, width = 1, 4
        while width <= SIDE_BY_SIDE:
            members = np.flatnonzero((size > low) & (size <= width))
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                flat, counts = self.many(np.frombuffer(b"".join([raws[k] for k in part.tolist()]), np.uint8), size[part], width)
                packed, edge = flat.tobytes(), np.concatenate([[0], np.cumsum(counts * 4)]).tolist()
                for k, a, b in zip(part.tolist(), edge, edge[1:], strict=False):
                    out[k] = packed[a:b]
            low, width = width, width * 2
        return out


@lru_cache(2)
def encoder(path: str) -> CachedEncoder:
    """One for each worker process."""
    vocabulary = Vocabulary(path)
    return CachedEncoder(vocabulary, SegmentTreeBpe(vocabulary).encode_words)


def id_lists(encoded: list[bytes]) -> pa.Array:
    """Packed ids as a list<int32> array."""
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def texts_of(lists: pa.Array, table: list[bytes]) -> pa.Array:
    """Decoded text of each list of ids."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
    edge = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    return pa.array([b"".join(map(table.__getitem__, flat[a:b])).decode("utf-8", "replace") for a, b in zip(edge, edge[1:], strict=False)], pa.string())


def _encoded(batches, path: str):
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        texts = batch.column("text").fill_null("")
        for a, b in chunks(offsets):
            out = encoder(path).encode(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), id_lists(out)], ["doc_id", "ids"])


def _decoded(batches, path: str):
    for batch in batches:
        text = texts_of(batch.column("ids"), encoder(path).vocabulary.bytes)
        yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: _encoded(batches, vocabulary_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and text: the ids' bytes as UTF-8."""
    encoded = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return encoded.mapInArrow(lambda batches: _decoded(batches, vocabulary_path), "doc_id long, ids array<int>, text string")


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """decode(encode(docs)) in one pass of one Python worker."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, vocabulary_path), vocabulary_path), "doc_id long, ids array<int>, text string")
