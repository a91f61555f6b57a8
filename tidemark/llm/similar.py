"""Near-duplicate documents by the similarity of their shingle sets: SimHash proposes links, the sets themselves decide.

1. Every document gets a SimHash of WIDE * 64 bits over its set of shingles; equal sets are one node.
2. Nodes meet in bands, choices of r bits; r grows with their number, and the number of bands so that a pair at the
   similarity asked for meets with probability RECALL. Inside a bucket the Gray-order index of llm/simhash.py finds all
   pairs within the limit, three standard deviations above what the similarity gives, of sizes that allow the similarity.
   A bucket that is large is cut into at most SIDES parts, every two of which meet, so that no pair is lost.
3. Sets of few shingles have fingerprints that vary much; they also meet by the prefixes of their sets in the order of
   shingle hashes, as two sets that are similar enough share a shingle in those (Bayardo, Ma and Srikant, 2007). No such
   pair is lost for not meeting.
4. Buckets return forests of proposed links. The nodes that these connect come together once more, with their sets, and
   every link is decided by the exact Jaccard similarity. Groups are the components of the links so found.

Defined cases: null or empty text has no shingles, and all such documents are one group; fewer words than a shingle make one
shingle; rows that share a doc_id, or have none, are not linked by that; repeated rows are in one group; further columns,
whatever their names, are carried or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import NULL_ID, fmix, staged, utf8
from .components import components
from .simhash import _buckets, forest, gray_rank, linked_pairs, shingle_hashes, spanning

#: 64-bit words of a fingerprint, and the share of pairs at the similarity asked for that are to meet in a band.
WIDE, RECALL = 8, 0.995
#: Nodes of a bucket or group, or shingles of a group, from which it is cut, and its parts, at most.
HOT, HOT_SHINGLES, SIDES = 1024, 1 << 21, 9
#: Sets of so many shingles or fewer meet by prefixes too, and the share of bits in which they may differ: that of sets of
#: four and five shingles, at similarity 0.8, which differ most.
SHORT, SHORT_DIFFER = 40, 0.1875

#: What tells a row from others: doc_id (null as NULL_ID) and 128 bits of the text, for rows may share an id.
ROW = ("key", "text_a", "text_b")


def with_row(docs: DataFrame) -> DataFrame:
    """row, a struct of the columns of docs, and the columns of ROW."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), key.alias(ROW[0]), F.xxhash64("text").alias(ROW[1]), F.xxhash64(F.lit(1), "text").alias(ROW[2]))


def _texts(docs: DataFrame) -> DataFrame:
    return with_row(docs.select("doc_id", "text")).select(F.col("row.text").alias("text"), *ROW)


def _set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


_FINGERPRINT = ("set_a", "set_b", "size", "prefix", "wide")


def wide_fingerprints(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The columns of ROW; set_a, set_b: 128 bits of the set of shingle hashes; size: its number; prefix: the hashes by
    which a small set meets others; wide: WIDE * 64 majority bits over the set."""
    seeds = np.random.default_rng(3).integers(1, 1 << 63, WIDE, dtype=np.uint64)

    def make(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                hashes = _set(data[a:b].tobytes(), words)
                n = len(hashes)
                counts = np.zeros(WIDE * 64, np.int64)
                for at in range(0, n, 4096):
                    many = fmix(hashes[at : at + 4096, None] + seeds)
                    counts += np.unpackbits(many.view(np.uint8).reshape(len(many), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                digest = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
                least = int(np.ceil(similarity * n - 1e-9))  # shingles that a similar set shares, at least
                prefix = hashes[: n - least + 1] if 0 < n <= SHORT / similarity else hashes[:0]
                for column, x in zip(out, (int(digest[0]), int(digest[1]), n, prefix.tobytes(), np.packbits(counts * 2 > n, bitorder="little").tobytes()), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*ROW, *_FINGERPRINT])

    return _texts(docs).mapInArrow(make, ", ".join(f"{c} long" for c in ROW) + ", set_a long, set_b long, size int, prefix binary, wide binary")


def near_edges(wide: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever links of at most `most` differing bits connect; none is missed.

    What lies within `most` of a pivot is linked to it and done with. Of the others, only those within `most` of the
    pivot's farthest can link to one of them (the triangle inequality), and one such link each is enough.
    """
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    left, a, b = np.arange(len(wide)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        d = apart(wide[left], wide[left[0]])
        own, left, d_own, d = left[d <= most], left[d > most], d[d <= most], d[d > most]
        a.append(np.full(len(own) - 1, own[0]))
        b.append(own[1:])
        ring = left[d <= most + d_own.max()]
        for x in range(0, len(own), 64):
            linked = np.zeros(len(ring), bool)
            for y in range(0, len(ring), 1024):
                near = apart(wide[own[x : x + 64], None], wide[ring[y : y + 1024]]) <= most
                hit = np.flatnonzero(near.any(axis=0))
                a.append(own[x + near.argmax(axis=0)[hit]])
                b.append(ring[y + hit])
                linked[y + hit] = True
            ring = ring[~linked]
            if not len(ring):
                break
    return np.concatenate(a), np.concatenate(b)


def similar_edges(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever pairs of sets (not empty) of a Jaccard similarity of at least `similarity` connect.

    By pivots, as in near_edges: one less the Jaccard similarity is a metric.
    """
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(code.max()) + 1, np.int64)

    def alike(pivot: int, others: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = code[edge[pivot] : edge[pivot + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        return both / (size[pivot] + size[others] - both)

    def taken(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of these sets one after the other, and where each set begins."""
        starts = np.cumsum(size[which]) - size[which]
        return code[np.arange(int(size[which].sum())) + np.repeat(edge[which] - starts, size[which])], starts

    least, far = similarity - 1e-9, 1 - similarity + 2e-9
    left, a, b = np.arange(len(sets)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        s = alike(left[0], left, *taken(left))
        own, rest = left[s >= least], left[s < least]
        a.append(np.full(len(own) - 1, own[0]))
        b.append(own[1:])
        ring = rest[1 - s[s < least] <= far + (1 - s[s >= least]).max()]
        flat = taken(ring)
        for x in own[1:]:
            if not len(ring):
                break
            hit = alike(x, ring, *flat) >= least
            if hit.any():
                a.append(np.full(int(hit.sum()), x))
                b.append(ring[hit])
                ring = ring[~hit]
                flat = taken(ring)
        left = rest
    return np.concatenate(a), np.concatenate(b)


def _parts(df: DataFrame, keys: list[str], large: DataFrame, names: list[str]) -> DataFrame:
    """df with part: 0, or, for rows of a large (keys, sides), a row for every two of its parts that its own is of."""
    own = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("sides") - 1), lambda x: x != F.col("own"))
    parts = F.transform(other, lambda x: F.least(x, F.col("own")) * SIDES + F.greatest(x, F.col("own")))
    cut = df.join(large, keys, "left").withColumn("own", own)
    return cut.withColumn("part", F.explode(F.when(F.col("sides").isNull(), F.array(F.lit(0))).otherwise(parts))).select(*names, "part")


def _sides(n: Column) -> Column:
    return F.least(F.lit(SIDES), 1 + F.ceil(n)).cast("int").alias("sides")


def _by_bucket(df: DataFrame, keys: list[str], bucket) -> DataFrame:
    """u, v of bucket(table) for the rows of each (keys, part)."""
    keys = [*keys, "part"]

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            change = np.zeros(max(t.num_rows - 1, 0), bool)
            for c in keys:
                x = t[c].to_numpy()
                change |= x[1:] != x[:-1]
            heads = np.flatnonzero(np.append(True, change)) if t.num_rows else np.zeros(1, np.int64)
            rest = t.slice(int(heads[-1]))  # the last bucket may go on
            yield from _buckets(t, heads, bucket)
        if rest is not None and rest.num_rows > 1:
            yield from bucket(rest).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _links(node: np.ndarray, root: np.ndarray) -> pa.Table:
    child = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"u": pa.array(node[child]), "v": pa.array(node[root[child]])})


def proposed(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of nodes (node, size, prefix, wide) that the fingerprints allow, as forests of buckets."""
    bits = WIDE * 64
    limit = lambda p: int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = nodes.count()
    r = int(np.clip(np.ceil(np.log2(max(n, 2))) - 7, 11, 40))
    bands = int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - differ) ** r)))
    rng = np.random.default_rng(17)
    chosen = [np.sort(rng.choice(bits, r, replace=False)) for _ in range(bands)]
    most, most_short, hot = limit(differ), limit(max(differ, SHORT_DIFFER)), HOT

    def rows_of(column) -> np.ndarray:
        return utf8(column)[0].reshape(-1, bits // 8)

    names = ["band", "value", "size", "wide", "node"]

    def deal(batches):
        for batch in batches:
            bit = np.unpackbits(rows_of(batch.column("wide")), axis=1, bitorder="little")
            kept = [batch.column(c) for c in names[2:]]
            for k, choice in enumerate(chosen):
                value = bit[:, choice].astype(np.int64) @ (1 << np.arange(len(choice), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), k, np.int32)), pa.array(value), *kept], names)
            data, offsets = utf8(batch.column("prefix"))
            which = pa.array(np.repeat(np.arange(len(bit)), np.diff(offsets) // 8))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), -1, np.int32)), pa.array(data.view(np.int64)), *(c.take(which) for c in kept)], names)

    dealt = nodes.where("size > 0").select("prefix", *names[2:]).mapInArrow(deal, "band int, value long, size int, wide binary, node long")
    sizes = dealt.groupBy("band", "value").agg(F.count("*").alias("n"))
    large, _ = staged(sizes.where(F.col("n") > hot).select("band", "value", _sides(F.col("n") / hot)))
    dealt = dealt.withColumn("part", F.lit(0)) if large.isEmpty() else _parts(dealt, ["band", "value"], large, names)

    def bucket(t: pa.Table) -> pa.Table:
        wide, node, size = rows_of(t["wide"]).view("<u8").astype(np.uint64), t["node"].to_numpy(), t["size"].to_numpy()
        bound = most if t["band"][0].as_py() >= 0 else most_short
        order = np.argsort(gray_rank(wide[:, 0]), kind="stable")
        wide, node, size = wide[order], node[order], size[order]
        if len(node) > hot:
            return _links(node, forest(len(node), *near_edges(wide, bound)))

        def pairs():
            for a, b in linked_pairs(wide, bound):
                fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
                yield a[fit], b[fit]

        return _links(node, spanning(len(node), pairs()))

    return _by_bucket(dealt, ["band", "value"], bucket).distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: the columns of ROW, and group, a number that is equal where documents are linked, directly or
    over others, by shingle sets of a Jaccard similarity of at least `similarity`."""
    fps, _ = staged(wide_fingerprints(docs, words, similarity))
    nodes, _ = staged(fps.select(*_FINGERPRINT).distinct().withColumn("node", F.monotonically_increasing_id()))  # staged: stays as it is
    found = components(proposed(nodes, similarity))
    member, _ = staged(found.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()))
    of_set = member.join(nodes.select("node", "set_a", "set_b", "size"), "node")
    sizes = member.join(nodes.select("node", "size"), "node").groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large, _ = staged(sizes.where((F.col("n") > HOT) | (F.col("shingles") > HOT_SHINGLES)).select("group", _sides(F.greatest(F.col("n") / HOT, F.col("shingles") / HOT_SHINGLES))))
    # One row of each node has its set made anew: of all texts, only those that a sketch of these rows lets through are read so.
    chosen = fps.select(*ROW, "set_a", "set_b").join(of_set.select("set_a", "set_b", "node", "group"), ["set_a", "set_b"])
    chosen, _ = staged(chosen.groupBy("node", "group").agg(F.min(F.struct(*ROW)).alias("row")).select("node", "group", "row.*"))

    def asked_keys(batches):
        for batch in batches:
            key = batch.column("text_a").to_numpy().view(np.uint64)
            yield np.concatenate([key, key])  # twice: its bit is set

    asked = sketch.merged(chosen.select("text_a"), asked_keys, sketch.width(chosen.count()))

    def sets(batches):
        for batch in batches:
            keep = np.flatnonzero(asked.value.may_repeat(batch.column("text_a").to_numpy().view(np.uint64)))
            batch = batch.take(pa.array(keep))
            data, offsets = utf8(batch.column("text"))
            made = [_set(data[a:b].tobytes(), words).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), pa.array(made, pa.binary())], [*ROW, "shingles"])

    made = _texts(docs).mapInArrow(sets, ", ".join(f"{c} long" for c in ROW) + ", shingles binary").join(chosen, list(ROW)).select("group", "node", "shingles")
    made = made.withColumn("part", F.lit(0)) if large.isEmpty() else _parts(made, ["group"], large, ["group", "node", "shingles"])

    def decide(t: pa.Table) -> pa.Table:
        node, first = np.unique(t["node"].to_numpy(), return_index=True)  # a row may be repeated
        if len(node) < 2:
            return _links(node, np.arange(len(node)))
        data, offsets = utf8(t["shingles"])
        return _links(node, forest(len(node), *similar_edges([data[offsets[k] : offsets[k + 1]].view(np.uint64) for k in first], similarity)))

    linked = components(_by_bucket(made, ["group"], decide))
    group = nodes.select("set_a", "set_b", "node").join(linked.select(F.col("u").alias("node"), F.col("v").alias("group")), "node", "left").select("set_a", "set_b", F.coalesce("group", "node").alias("group"))
    return fps.select(*ROW, "set_a", "set_b").join(group, ["set_a", "set_b"]).select(*ROW, "group")
