"""Periodic runs against a literal search, lag by lag."""

import random

import numpy as np
import pytest

import brute
from hearthline.llm import periodic

SCHEMA = "doc_id long, text string, runs string, n_words string"


def numbers(words):
    return np.array([hash((w, 7)) & (1 << 63) - 1 for w in words], np.uint64)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_and_planted_runs(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            root = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (root * 6)[: rng.randrange(len(root) * 6)]
        found = periodic.find_runs(numbers(words), len(words))
        assert [tuple(r) for r in found.tolist()] == brute.runs(words)


def test_classes_leave_no_lag_out():
    lags = [q for low, high in periodic.lag_classes(4000) for q in range(low, high + 1)]
    assert lags[:1000] == list(range(1, 1001))
    assert all(2 * high <= 3 * low for low, high in periodic.lag_classes(10**6))


def test_texts(spark):
    """Nulls, blanks, long texts of one word, repeated rows and ids, clashing columns."""
    rng = random.Random(3)
    word = lambda: rng.choice(["aa", "b", "ç d", "E"])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["x " * 200_000, "a b " * 6 + "c", "", " \t\n", None, "a a " * 9, "A a " * 8]
    rows = [(i, t, "r", "n") for i, t in enumerate(texts)] + [(3, texts[3], "r", "n"), (3, "y " * 9, "r", "n"), (None, "z " * 7, "r", "n")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = periodic.collapse(frame).collect()
    key = lambda r: tuple(map(str, r))
    expected = []
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        runs = brute.runs(words) if len(words) < 1000 else [(0, 200_000, 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        expected.append((doc, len(words), runs, kept))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert periodic.collapse(frame.limit(0)).collect() == []
