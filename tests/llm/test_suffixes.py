"""Repeated strings of bytes against a count of every window."""

import hashlib
import random

import numpy as np
import pytest

import brute
from hearthline.llm import suffixes

SCHEMA = "doc_id long, text string, doc string, cuts string"


def corpus(rng):
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop é ") for _ in range(n))
    shared = [prose(n) for n in (150, 199, 200, 201, 263, 264, 500, 3000)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += [prose(rng.randrange(120)), rng.choice(shared)]
            if rng.random() < 0.4:
                low = rng.randrange(len(parts[-1]))
                parts[-1] = parts[-1][low : low + rng.randrange(1, 600)]
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 5000), (201, "ab" * 900), (202, "a" * 199), (203, "b" * 200), (204, "c" * 201), (205, None), (206, "")]
    rows += [(207, prose(400)), (208, prose(700))]
    rows += [rows[-1], (208, rows[-2][1]), (None, rows[-1][1]), (None, rows[-2][1]), (209, "x" * 30 + prose(240) * 2 + "y" * 130)]
    # One common line with other words around it each time.
    line = prose(230)
    return rows + [(300 + i, prose(90) + line + prose(90)) for i in range(60)]


@pytest.mark.parametrize("together", [suffixes.SORTED, 3])
def test_equals_brute_force(spark, together):
    """All anchors sorted, and most of them by window."""
    rows = corpus(random.Random(11))
    frame = spark.createDataFrame([(i, t, "d", "c") for i, t in rows], SCHEMA).repartition(5)
    found = suffixes.deduplicate(frame, together).collect()
    got = [
        (r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in found
    ]
    assert sorted(got, key=str) == sorted(brute.op13(rows), key=str)
    assert suffixes.deduplicate(frame.limit(0)).collect() == []


def test_blocks_of_long_texts(spark, monkeypatch):
    """Texts cut into small blocks give the same bytes."""
    monkeypatch.setattr(suffixes, "_BLOCK", 1 << 9)
    rows = corpus(random.Random(12))[:90]
    frame = spark.createDataFrame([(i, t, "d", "c") for i, t in rows], SCHEMA)
    found = suffixes.deduplicate(frame).collect()
    got = [(r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest()) for r in found]
    assert sorted(got) == sorted((r[0], r[1], r[4]) for r in brute.op13(rows))


def test_mergesort_and_extensions():
    rng = random.Random(5)
    for _ in range(60):
        body = bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 80)))
        starts = np.arange(len(body))
        groups = np.array([rng.randrange(2) for _ in body])
        got = suffixes.Suffixes(np.frombuffer(body, np.uint8), starts, np.full(len(body), len(body)), groups)
        assert got.order.tolist() == sorted(range(len(body)), key=lambda i: (groups[i], body[i:]))


def test_collisions_are_found(monkeypatch):
    """Hashes that never tell strings apart are seen to collide, and others are taken."""
    taken = []

    class Blind(suffixes.Polynomial):
        def __init__(self, size, seed=0):
            super().__init__(size, seed)
            taken.append(seed)

        def of(self, prefix, start, end):
            got = super().of(prefix, start, end)
            return got * np.uint64(0) if taken[-1] == 3 else got

    monkeypatch.setattr(suffixes, "Polynomial", Blind)
    body = b"abracadabra"
    got = suffixes.Suffixes(np.frombuffer(body, np.uint8), np.arange(11), np.full(11, 11), np.zeros(11, np.int64))
    assert taken == [3, 4] and got.order.tolist() == sorted(range(11), key=lambda i: body[i:])
