"""Near-duplicate vectors and exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import neardup, topk
from hearthline.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "clash") for i, x in rows], SCHEMA)


def clusters(seed, groups, size, dims=16, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dims))
    x = np.repeat(centres, size, axis=0) + spread * r.standard_normal((groups * size, dims))
    return x.astype(np.float32)


def brute_components(n, i, j):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(i, j):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "t").collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", "t").collect() == []


@pytest.mark.parametrize("block", [1024, 8])
def test_links_and_components(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    x = np.vstack([clusters(1, 12, 12), clusters(2, 1, 60, spread=0.12), clusters(3, 150, 1)])
    x[5] = x[4]
    x[6] = 3 * x[4]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= neardup.THRESHOLD
    np.fill_diagonal(near, False)
    root = brute_components(len(x), *np.nonzero(near))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {r["vec_id"]: r for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    exact = sum(found[i]["n_links"] == near[i].sum() for i in range(len(x)))
    assert exact >= 0.95 * len(x) and all(found[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert sum(found[i]["component_id"] == root[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


@pytest.mark.parametrize("hashes", [1, 2, 3, 4, 5, 6])
def test_recall_stays_level_with_the_number_of_hashes(hashes):
    """Pairs whose cosine is the threshold itself share a bucket, whatever the size of the table."""
    r = np.random.default_rng(hashes)
    a, b = r.standard_normal((2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = neardup.THRESHOLD * a + np.sqrt(1 - neardup.THRESHOLD**2) * b
    tables = neardup.table_count(hashes)
    left, right = (neardup.buckets(x, hashes, tables, neardup.PROBES) for x in (a, near))
    met = (left[:, :, :, None] == right[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.99 and tables == [8, 8, 8, 14, 24, 40][hashes - 1]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 0.0]), (6, [1.0, None]), (7, []),
            (8, [2.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1e-30, 0.0])]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["vec_id"]: r for r in found}
    assert [by[i]["n_links"] for i in (2, 3, 4, 5, 6, 7)] == [0] * 6
    assert [by[i]["component_id"] for i in (1, 8, 9)] == [1, 1, 1] and by[1]["n_links"] == 3
    assert not by[None]["kept"] and by[None]["component_id"] is None
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    # Candidates of query 8: ids 1, 3, 7, 9; (1, 0) scores 512 * 256, the others 0.
    top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame(spark, rows), F.col("vec_id") == 8).collect()}
    assert top == {(8, 1): (1, 512 * 256), (8, 2): (3, 0), (8, 3): (7, 0), (8, 4): (9, 0)}


@pytest.mark.parametrize("block, chunk", [(16, 100), (2, 12)])
def test_top_k_is_exact_with_ties(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "DATA_CHUNK", chunk)
    x = np.vstack([clusters(5, 6, 60, dims=8, spread=0.02), np.tile(clusters(6, 1, 1, dims=8), (80, 1))])
    ints = np.floor(256 * x.astype(float)).astype(int)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    expected = {}
    for q in range(0, len(x)):
        if q * 3 % 5 == 0:
            order = sorted((-(ints[q] @ ints[j]), j * 3) for j in range(len(x)) if j != q)[:5]
            expected |= {(q * 3, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
    assert got == expected


def test_routes_leave_out_what_is_too_far(monkeypatch):
    monkeypatch.setattr(topk, "DATA_CHUNK", 100)
    apart = np.array([[0.0, 10.0, 50.0], [10.0, 0.0, 41.0], [50.0, 41.0, 0.0]])
    bands = [(0, 0, 60, 0.0, 1.0), (1, 0, 90, 0.0, 2.0), (1, 1, 250, 2.0, 9.5), (2, 0, 30, 0.0, 3.0)]
    # Neighbours within 2 of queries within 1 of pivot 0: its own cell, and of cell 1 radii from 7 on.
    found = topk.routes([(0, 1.0, 2.0, 4), (2, 0.5, np.inf, 1)], bands, apart, 0.0)
    assert [r for r in found if r[2] == 0] == [(0, 0, 0, -3.0, 3.0, 4, 0, 1), (1, 1, 0, 7.0, 13.0, 4, 1, 3)]
    # Without a bound everything comes; 60 and 90 rows do not fit one bin, 250 take three.
    assert [(r[0], r[1], r[6], r[7]) for r in found if r[2] == 2] == [(0, 0, 0, 1), (1, 0, 1, 1), (1, 1, 2, 3), (2, 0, 5, 1)]


def test_big_components_stay_exact():
    q, d = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 3.0]])
    assert topk.products(q, d).tolist() == [[2**60 + 1, 2**60 + 3]]
