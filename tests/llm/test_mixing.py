"""Mixing: targets by hand, copies near them, edge rows."""

import pytest
from pyspark.sql import functions as F

from hearthline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def water(sizes, weights, ratio, cap):
    """Targets by repeated resharing, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + (
        [None] if None in sizes else []
    )
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = ratio * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 7}" if i % 7 else None) for i in range(3000)]
    docs = frame(spark, rows)
    found = mixing.taken(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    aims = water(sizes, (5, 2, 1), 1.5, 2.0)
    taken = {}
    for r in found:
        assert r["target"] == pytest.approx(aims[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, aim in aims.items():
        assert abs(taken[source] - aim) <= 40
    assert sorted(found) == sorted(mixing.taken(docs).collect())


def test_a_hot_source_passes_several_levels(spark):
    rows = [(i, "w " * (1 + i % 30), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    old, mixing.BLOCK = mixing.BLOCK, 4
    try:
        found = mixing.taken(frame(spark, rows), weights=(1, 1)).collect()
    finally:
        mixing.BLOCK = old
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30


def test_edges(spark):
    assert mixing.taken(frame(spark, [])).count() == 0
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 100_000, "a"), (3, "y", None)]
    found = mixing.taken(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r["taken"] for r in found if r["size"] == 0} == {0}
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    per_doc = mixed.filter(F.length("text") > 0).groupBy("doc_id").count().collect()
    expected = {r["doc_id"]: r["taken"] // r["size"] for r in found if r["size"] and r["taken"]}
    assert {r["doc_id"]: r["count"] for r in per_doc} == expected
