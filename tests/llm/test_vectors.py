"""Vector searches against brute force, with unusable, equal and repeated vectors."""

import numpy as np
import pytest

from tidemark.llm import ann, topk
from tidemark.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, leaf int, score string, vec string"


def rows(n=900, d=8):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, d)).astype(np.float32)
    v[100:400] = v[100]  # a third are alike
    out = [(k, [float(x) for x in v[k]], 1, "s", "v") for k in range(n)]
    out[50] = (50, None, 1, "s", "v")
    out[200] = (200, [float("nan")] * d, 1, "s", "v")
    out[300] = (300, [None] * d, 1, "s", "v")
    out[500] = (500, [0.0] * d, 1, "s", "v")
    out[600] = (600, [float("inf")] + [1.0] * (d - 1), 1, "s", "v")
    out[700] = (700, [1.0, 2.0], 1, "s", "v")
    return [*out, out[7], out[7], (None, [1.0] * d, 1, "s", "v")]


def usable(zero):
    seen = {}
    for i, v, *_ in rows():
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            seen[i] = np.array(v, np.float64)
    return seen


def test_top_inner_products(spark):
    ship_package(spark)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    v = {i: np.floor(256 * x).astype(int) for i, x in usable(True).items()}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_inner_products(df, "embedding", "vec_id % 50 = 0", 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("shard", [40, 300])
def test_top_inner_products_over_rounds(spark, monkeypatch, shard):
    ship_package(spark)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "PART", 70)
    test_top_inner_products(spark)


def test_nearest_with_tiny_leaves(spark, monkeypatch):
    """A single visit asked for, leaves of a few rows: every query still gets its ten."""
    ship_package(spark)
    monkeypatch.setattr(ann, "LEAF", 4)
    monkeypatch.setattr(ann, "_calibrated", lambda *a: 1)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    counts = {}
    for r in ann.nearest(df, "embedding", "vec_id % 100 = 0", 10).collect():
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
    assert set(counts.values()) == {10} and len(counts) == len([i for i in usable(False) if i % 100 == 0])


def test_nearest(spark):
    ship_package(spark)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    v = usable(False)
    got = {}
    for r in ann.nearest(df, "embedding", "vec_id % 100 = 0", 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in v if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        true = {i: np.sqrt(((v[q] - x) ** 2).sum()) for i, x in v.items() if i != q}
        order = sorted(true, key=lambda i: (true[i], i))[:10]
        hits += len(set(order) & {i for i, _ in found.values()})
        assert sorted(found) == list(range(1, 11)) and all(true[i] == s for i, s in found.values())
        assert [x for _, x in sorted(found.items())] == sorted(found.values(), key=lambda x: (x[1], x[0]))
    assert hits >= 9 * len(got)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    ship_package(spark)
    df = spark.createDataFrame([(k, [1.0, float(k)], 0, "", "") for k in range(n)], SCHEMA)
    assert ann.nearest(df, "embedding", "vec_id % 1 = 0", 10).count() == n * (n - 1)
    assert topk.top_inner_products(df, "embedding", "vec_id % 1 = 0", 5).count() == n * (n - 1)
