"""Periodic runs of words, found online along sparse diagonals.

Words are read from left to right. Word ``i`` that equals its earlier occurrence
``i - q`` lengthens the match on the diagonal (lag) ``q``; a diagonal that is not
lengthened ends, and gives out its run at once if the match was long enough.

Of the earlier occurrences of a word only one can lengthen a run, so only that one
is followed. Lags are taken in classes ``m .. hi`` with ``hi < 1.5 m``, and an
occurrence counts only if the ``3 m`` words from it on are the same too. A run of
smallest period ``q`` holds at least four periods, so every word but those of its
first period and its last ``3 m - 1`` words has such an occurrence at lag ``q``. A
nearer one at lag ``d < q`` would give those ``3 m >= d + q`` words the periods
``d`` and ``q``, hence their greatest common divisor (Fine and Wilf), and the run a
smaller period. So the *nearest* earlier occurrence with that context has lag ``q``
for exactly these words: each word has at most one active diagonal per class, its
stretch of equal lags is the run, and no run comes out under a multiple of its
period. Work is n log n for any text, one word repeated a million times included.

Words whose three words do not occur again in the text leave after the first class,
which is nearly all of them in prose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import prepare

#: A run has this many words and periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words whose hashes a task remembers, words that it looks through at a time (one text at least).
REMEMBERED, TOGETHER = 300_000, 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Hashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def lag_classes(longest: int) -> Iterator[tuple[int, int]]:
    """Smallest and largest lag of each class, as far as a text of ``longest`` words can have runs."""
    low = 1
    while MIN_PERIODS * low <= longest:
        high = -(-3 * low // 2) - 1
        yield low, max(low, high)
        low = max(low, high) + 1


class Contexts:
    """Hashes of the words from a place on, by doubling."""

    def __init__(self, marks: np.ndarray) -> None:
        self.size, self.doubled = 1, marks

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` words from each place; lengths must not fall from call to call."""
        while 2 * self.size <= length:
            now = self.doubled
            self.doubled = _mixed(now[: -self.size] * _ODD + (now[self.size :] ^ (now[self.size :] >> np.uint64(27))))
            self.size *= 2
        first, last = self.doubled[places], self.doubled[places + (length - self.size)]
        return _mixed(first * _ODD + (last ^ (last >> np.uint64(27))))


def find_runs(marks: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in a row of words given by their hashes.

    Several texts may stand behind each other if none shares a mark with another;
    ``longest`` is the length of the longest.
    """
    found = [np.zeros((0, 3), np.int64)]
    places, contexts = np.arange(len(marks)), Contexts(marks)
    for low, high in lag_classes(longest):
        length = 3 * low
        places = places[: np.searchsorted(places, len(marks) - length, side="right")]
        if len(places) < 2:
            break
        value = contexts.at(places, length)
        order = np.argsort(value, kind="stable")
        same = value[order[1:]] == value[order[:-1]]
        lag = np.zeros(len(places), np.int64)
        lag[order[1:]] = np.where(same, places[order[1:]] - places[order[:-1]], 0)
        active = np.flatnonzero((lag >= low) & (lag <= high))
        if len(active):
            at, by = places[active], lag[active]
            ends = np.flatnonzero((np.diff(at) != 1) | (np.diff(by) != 0))
            first, last = at[np.append(0, ends + 1)], at[np.append(ends, len(at) - 1)]
            period = by[np.append(0, ends + 1)]
            size = last + length - (first - period)
            enough = size >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
            found.append(np.stack([first - period, size, period], axis=1)[enough])
        again = np.zeros(len(places), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        places = places[again]
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def collapse(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    Words are anything between ASCII white space, as UTF-8 bytes. A run is a
    stretch of at least ``MIN_WORDS`` words and ``MIN_PERIODS`` times its smallest
    period that no neighbouring word extends; ``runs`` has (start, length, period)
    by start, then period. ``collapsed`` joins by one space the words that no run
    contains after its first period. ``edit`` may change a text's words first.

    Every row stands for itself, repeated ids and null ids too. Null, empty and
    blank texts have no words, no runs and an empty ``collapsed``. Other columns
    are not looked at; an empty table gives no rows. A text is held whole by the
    one task that reads it; nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def finished(held: list[tuple[int | None, list[bytes]]], known: Hashes) -> pa.RecordBatch:
        sizes = np.array([len(words) for _, words in held], np.int64)
        marks = np.fromiter((known[w] for _, words in held for w in words), np.uint64, int(sizes.sum()))
        # Marks of different texts are different, so no diagonal leaves its text.
        marks = _mixed(marks + np.repeat(np.arange(1, len(held) + 1, dtype=np.uint64), sizes) * _ODD)
        runs = find_runs(marks, int(sizes.max(initial=0)))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.searchsorted(runs[:, 0], starts)
        texts = []
        for i, (_, words) in enumerate(held):
            if cuts[i] < cuts[i + 1]:
                words = _collapsed(words, runs[cuts[i] : cuts[i + 1]] - [starts[i], 0, 0])
            texts.append(b" ".join(words))
        runs[:, 0] -= np.repeat(starts[:-1], np.diff(cuts))
        items = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc for doc, _ in held], pa.int64()),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                pa.array(texts, pa.binary()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, waiting = Hashes(), [], 0
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = (text.as_py() or b"").split()
                held.append((doc, edit(doc, words) if edit else words))
                waiting += len(held[-1][1])
                if waiting >= TOGETHER or len(held) >= 1000:
                    yield finished(held, known)
                    held, waiting = [], 0
        if held:
            yield finished(held, known)

    return (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
        .withColumn("collapsed", F.col("collapsed").cast("string"))
    )
