"""Spelling variants against sets of words with a letter left out."""

import random

import numpy as np

import brute
from hearthline.llm import bloom, variants

SCHEMA = "doc_id long, text string, word string, n string"


def corpus(rng, documents=120):
    letters = "abcdeéÀ÷"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(40)]
    roots += ["z" * 700, "y" * 6, "y" * 7]

    def word():
        w = rng.choice(roots) if rng.random() < 0.8 else rng.choice(roots[:3])
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[at]]) + w[at + 1 :]
        return w.upper() if rng.random() < 0.1 and w.isascii() else w

    rows = [(i, rng.choice([" ", "1", "-"]).join(word() for _ in range(rng.randrange(150)))) for i in range(documents)]
    chain = "abcabcde " * 200 + "abcabcdé " * 30 + "abcabceé " * 5
    return rows + [(None, chain), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1])]


def test_equals_brute_force(spark):
    rows = corpus(random.Random(2))
    frame = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], SCHEMA).repartition(3)
    found = variants.group(frame, 199).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = brute.op12(rows)
    assert sorted(map(tuple, found)) == expected and any(r[1] for r in expected)
    assert any(r[1] and r[2] != r[1] for r in expected)
    assert variants.group(frame.limit(0)).collect() == []


def test_full_filters_change_nothing(spark, monkeypatch):
    """Filters far too small let nearly everything through; the join still decides."""
    rows = corpus(random.Random(4), 40)
    frame = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], SCHEMA)
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)
    found = variants.group(frame, 199).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, found)) == brute.op12(rows)


def test_filters_hold_what_they_were_given(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 62), 1 << 62, 3000)
    frame = spark.createDataFrame([(int(v) % 3, int(v)) for v in values], "shard int, hash long")
    shards = bloom.build(frame)
    for shard in range(3):
        own = values[values % 3 == shard].astype(np.int64).view(np.uint64)
        assert bloom.held(shards[shard], own).all()
    assert bloom.held(shards[0], rng.integers(0, 1 << 62, 10_000).astype(np.uint64)).mean() < 0.02
    assert not bloom.held(shards.get(9), values.view(np.uint64)).any()
