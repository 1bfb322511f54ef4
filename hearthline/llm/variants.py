"""Spelling variants of frequent words, by Bloom-guided neighbourhoods.

Edits of every word are generated and probed against blocked Bloom filters of the
vocabulary, one filter per word length; they are built by Spark and broadcast, and
their size has a bound. Only edits that the filters let through are shuffled, to an
exact join with the vocabulary that removes what they let through wrongly.

A word is a row of letters; a hash of it is the exclusive or of one value per
letter and place, so the hash of an edited word follows from two running sums
without building the word. A pair that differs by an inserted letter is found from
its longer word, by deletion; a replaced letter is found from both words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import bloom
from hearthline.llm.common import prepare, scalar, stored

#: Code points and occurrences that a word of the vocabulary has at least.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs this many times as often as the word.
TIMES = 5
#: One in so many words of a document (by hash) loses a letter before it is counted.
DAMAGED = 199
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Probes that a task holds at a time.
PROBES = 1 << 20

# Fixed by the definition of a word: lower-case letters and U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))

_LETTERS = len(ALPHABET)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _damaged(word: bytes, mark: int) -> bytes:
    letters = word.decode()
    at = mark % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def counted(docs: DataFrame, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n): words of ``MIN_LENGTH`` letters and more, with their occurrences in all texts.

    With ``damaged``, of the runs whose crc32 of ``<doc_id>:<run>`` it divides, the
    letter at that crc32 modulo the run's length is taken out first. Rows whose id
    is null are counted as they are.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

    def long_enough(word: bytes) -> bool:
        return len(word) >= MIN_LENGTH and (len(word) >= 2 * MIN_LENGTH or len(word.decode()) >= MIN_LENGTH)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = _RUN.findall((text.as_py() or b"").lower())
                if damaged and doc is not None:
                    before = zlib.crc32(b"%d:" % doc)
                    words = [w if (h := zlib.crc32(w, before)) % damaged else _damaged(w, h) for w in words if len(w) >= MIN_LENGTH]
                total.update(words)
                if len(total) >= COUNTED:
                    yield batch(Counter({w: n for w, n in total.items() if long_enough(w)}))
                    total = Counter()
        yield batch(Counter({w: n for w, n in total.items() if long_enough(w)}))

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _values(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The value of each letter at its place."""
    x = places.astype(np.uint64) * np.uint64(128) + letters.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * _FACTORS[1] + _FACTORS[0]
    x = (x ^ (x >> np.uint64(27))) * _FACTORS[2]
    return x ^ (x >> np.uint64(31))


_CODE = np.full(256, 255, np.uint8)
for _i, _letter in enumerate(ALPHABET):
    _CODE[ord(_letter)] = _i


def letters_of(words: list[str], length: int) -> np.ndarray:
    """One row of letter numbers per word; all words have ``length`` letters."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, length)


def word_hashes(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_values(np.arange(rows.shape[1])[None, :], rows), axis=1)


def filters(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """Bloom filters of the words, by their length."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for length, words in _by_length(part.column(0).to_pylist()):
                values = word_hashes(letters_of(words, length)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), length, np.int32)), pa.array(values)], names=["shard", "hash"]
                )

    return bloom.build(vocabulary.select("word").mapInArrow(run, "shard int, hash long"))


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    yield from groups.items()


def probed(words: list[str], shards: dict[int, np.ndarray]) -> Iterator[tuple[str, str, bool]]:
    """(word, edited word, deleted): edits of words of one length that the filters let through."""
    length = len(words[0])
    step = max(1, PROBES // (length * _LETTERS))
    for start in range(0, len(words), step):
        some = words[start : start + step]
        rows = letters_of(some, length)
        place = np.arange(length)[None, :]
        own = _values(place, rows)
        whole = np.bitwise_xor.reduce(own, axis=1)
        # Deleted letters: those behind move one place down. Of equal neighbours one is taken out.
        moved = _values(np.maximum(place - 1, 0), rows)
        front = np.bitwise_xor.accumulate(own, axis=1) ^ own
        back = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
        fresh = np.ones(rows.shape, bool)
        fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
        which, at = np.nonzero(fresh)
        hit = bloom.held(shards.get(length - 1), (front ^ back)[which, at])
        for i, p in zip(which[hit].tolist(), at[hit].tolist()):
            yield some[i], some[i][:p] + some[i][p + 1 :], True
        every = _values(np.arange(length)[:, None], np.arange(_LETTERS)[None, :])
        edits = (whole[:, None] ^ own)[:, :, None] ^ every[None, :, :]
        hit = bloom.held(shards.get(length), edits.ravel()).reshape(edits.shape)
        hit &= rows[:, :, None] != np.arange(_LETTERS, dtype=np.uint8)
        for i, p, c in zip(*(x.tolist() for x in np.nonzero(hit))):
            yield some[i], some[i][:p] + ALPHABET[c] + some[i][p + 1 :], False


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): words of the vocabulary that differ by one letter, in both directions."""
    spark = vocabulary.sparkSession
    shards = spark.sparkContext.broadcast(filters(vocabulary))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("deleted", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            count = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            for _, words in _by_length(list(count)):
                held: list[tuple] = []
                for word, near, deleted in probed(words, shards.value):
                    held.append((word, count[word], near, deleted))
                    if len(held) >= 50_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
                        held = []
                if held:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*held), schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    # Words are dealt anew: what the count left in one task may be most of them.
    dealt = vocabulary.select("word", "n").repartition(F.col("word"))
    found = dealt.mapInArrow(run, "word string, n long, near string, deleted boolean")
    exact = stored(
        found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"), "near-words"
    )
    back = exact.filter("deleted").select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exact.select("word", "near", "near_n").unionByName(back)


def group(docs: DataFrame, damaged: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word with most occurrences (ties: the first in
    code-point order), if those are ``TIMES`` times the word's or more; ``root``
    follows forms to the last one. Null and empty texts have no words; rows that
    repeat an id count like any other; an empty table gives no rows. Very long
    words are words. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    vocabulary = stored(counted(docs, damaged).filter(F.col("n") >= MIN_COUNT), "vocabulary")
    best = (
        near_words(vocabulary)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"),
        )
    )
    form_n = -F.col("best.rank")
    enough = form_n >= TIMES * F.col("n")
    words = stored(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, form_n).alias("form_n"),
        ),
        "word-forms",
    )
    return words.join(_roots(words), "word", "left").select(
        "word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words whose form has a form: paths halve until every one ends.

    Occurrences grow ``TIMES`` times with every step, so paths end, and soon.
    """
    steps = words.filter("form is not null").select("word", F.col("form").alias("root"))
    turn = 0
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(
            steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            f"word-roots{turn}",
        )
        if not scalar(after.agg(F.count_if("moved"))):
            return after.select("word", "root")
        steps, turn = after.select("word", "root"), turn + 1
