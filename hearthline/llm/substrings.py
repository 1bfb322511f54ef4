"""Substring de-duplication by sliding sentence spans.

A text is cut into short sentences: behind a mark, at a line end, and behind any
word whose hash is less than those of the two words on either side of it. Only a
few neighbours decide, so a passage is cut alike wherever it was pasted, but for
a few words at its ends. From every sentence on, the span of whole sentences that
has ``SPAN_WORDS`` words or more is hashed. Spans that occur more than once are
found by a global count of hashes; every occurrence but the first loses its
sentences.

The hashes of a text's spans are stored once; they are counted and placed from there.
Positions are only moved for spans whose hash occurs again (a Bloom filter of those
hashes is broadcast; what it lets through wrongly goes in the exact count).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import bloom
from hearthline.llm.common import batches, prepare, stored, texts

#: Words that a span of whole sentences has at least.
SPAN_WORDS = 24
#: Words whose hashes a task remembers.
REMEMBERED = 300_000

# Fixed by the definition of a word: characters of scripts without spaces stand alone.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_SCRIPT = re.compile(f"[{_ALONE}]")
_WORD = re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")
#: A sentence ends behind a word that ends with one of these.
MARKS = ".!?,;:…。！？、，；："

_PLAIN = re.compile(r"\S+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Marks(dict):
    """Hash of a word in lower case, remembered; odd if the word ends with a mark."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.lower()) & ~1 | (word[-1] in MARKS)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _alone(text: str) -> bool:
    """Whether a text has characters that stand alone; none of the first 256 does."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SCRIPT.search(text) is not None
    return False


def words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, as they stand, and the number of words up to each line end."""
    split = _WORD.findall if _alone(text) else str.split
    out: list[str] = []
    ends = []
    for line in text.split("\n"):
        out += split(line)
        ends.append(len(out))
    return out, ends


def sentence_ends(marks: np.ndarray, line_ends: list[int]) -> np.ndarray:
    """Number of words up to the end of each sentence; the last is the number of words."""
    n = len(marks)
    last = (marks & np.uint64(1)) == 1
    if n >= 5:
        inner = marks[2:-2]
        last[2:-2] |= (inner < marks[:-4]) & (inner < marks[1:-3]) & (inner < marks[3:-1]) & (inner < marks[4:])
    at = np.array(line_ends, np.int64)
    last[at[at > 0] - 1] = True
    return np.flatnonzero(last) + 1


class Spans:
    """Sentences and spans of texts."""

    def __init__(self) -> None:
        self.known = Marks()
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(marks of the words, number of words up to the end of each sentence)."""
        split, line_ends = words(text)
        marks = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        return marks, sentence_ends(marks, line_ends)

    @staticmethod
    def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end) of the span from each sentence on, as far as there are any."""
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        last = np.searchsorted(ends, starts + SPAN_WORDS)
        found = last < len(ends)
        return starts[found], ends[last[found]]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the span from each sentence on."""
        marks, ends = self.sentences(text)
        if len(marks) < SPAN_WORDS:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts, stops = self.places(ends)
        if len(self.power) <= len(marks):
            size = 2 * len(marks) + 1
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _ODD)]))
            back = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, back)]))
        mixed = (marks ^ (marks >> np.uint64(29))) * _ODD
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[: len(marks)])])
        value = (prefix[stops] - prefix[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64)
        value = (value ^ (value >> np.uint64(31))) * _ODD
        return value ^ (value >> np.uint64(30)), starts


def _spans(docs: DataFrame) -> DataFrame:
    """(none, doc, text_id, ats, spans): first words and hashes of the spans of every text.

    ``none`` tells null ids. Rows with the same id and text are one document. Texts
    without spans have no row.
    """
    schema = pa.schema(
        [
            ("none", pa.bool_()), ("doc", pa.int64()), ("text_id", pa.int64()),
            ("ats", pa.list_(pa.int32())), ("spans", pa.list_(pa.int64())),
        ]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for part in parts:
            which, at, values = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, text in enumerate(texts(part.column(3))):
                value, start = spans.of(text)
                if len(value):
                    which.append(i)
                    at.append(start)
                    values.append(value)
            ends = pa.array(np.cumsum([len(v) for v in values]).astype(np.int32))
            lists = (np.concatenate(at).astype(np.int32), np.concatenate(values).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i).take(pa.array(which, pa.int64())) for i in range(3)),
                    *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists),
                ],
                schema=schema,
            )

    return _keyed(docs).select("none", "doc", "text_id", "text").mapInArrow(
        run, "none boolean, doc long, text_id long, ats array<int>, spans array<long>"
    )


def _again(spans: DataFrame) -> DataFrame:
    """(shard, hash) of the spans that occur more than once."""
    seen = spans.select(F.explode("spans").alias("hash"))
    return seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(0).alias("shard"), "hash")


def _places(spans: DataFrame, again: np.ndarray | None) -> DataFrame:
    """(none, doc, text_id, at, span) of the spans that may occur again."""
    shared = spans.sparkSession.sparkContext.broadcast(again)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, value = part.column(3).flatten(), part.column(4).flatten()
            held = bloom.held(shared.value, value.to_numpy(zero_copy_only=False).view(np.uint64))
            keep = pa.array(np.flatnonzero(held))
            rows = pc.list_parent_indices(part.column(4)).take(keep)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(rows) for i in range(3)), at.take(keep), value.take(keep)],
                names=["none", "doc", "text_id", "at", "span"],
            )

    return spans.select("none", "doc", "text_id", "ats", "spans").mapInArrow(
        run, "none boolean, doc long, text_id long, at int, span long"
    )


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(none, doc, text_id, text): the first three tell documents apart."""
    return docs.select(
        *more,
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64("text", F.length("text")).alias("text_id"),
        "text",
    )


def _place() -> Column:
    """Ids first, null last; within an id by text, within a text by place."""
    return F.struct("none", "doc", "text_id", "at")


def _without(text: str, cuts: list[int], spans: Spans) -> tuple[str, int, int]:
    """Text without the sentences of the spans that begin at ``cuts``, and numbers of sentences."""
    marks, ends = spans.sentences(text)
    if not cuts:
        return text, len(ends), 0
    starts, stops = spans.places(ends)
    gone = np.zeros(len(marks) + 2, bool)
    for at in np.searchsorted(starts, np.array(sorted(cuts))):
        gone[starts[at] + 1 : stops[at] + 1] = True
    places = [m.span() for m in (_WORD if _alone(text) else _PLAIN).finditer(text)]
    steps = np.flatnonzero(np.diff(gone))
    kept, at = [], 0
    for first, last in zip(steps[::2].tolist(), steps[1::2].tolist()):
        kept.append(text[at : places[first][0]])
        at = places[last][0] if last < len(places) else len(text)
    return ("".join(kept) + text[at:]).rstrip(), len(ends), int(gone[ends].sum())


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` without repeated sentences: doc_id, text, n_sentences, n_removed.

    A sentence goes if it lies in a span that occurred before. The first occurrence
    is the one with the smallest id (null ids last), then the first in the text;
    it stays. Rows that repeat id and text are one document and come out alike.
    Null texts stay null, empty ones empty, with no sentences. Texts of fewer than
    ``SPAN_WORDS`` words lose nothing. Words of scripts without spaces are their
    characters. An empty table gives no rows; other columns are not returned.
    """
    prepare(docs.sparkSession)
    # Hashed once and stored; they are read to count and to place them.
    spans = stored(_spans(docs), "spans")
    again = stored(_again(spans), "spans-again")
    shard = bloom.build(again).get(0)
    places = stored(_places(spans, shard), "span-places")
    first = places.groupBy("span").agg(F.min(_place()).alias("origin"), F.max(_place()).alias("last")).filter("origin < last")
    # Stored, so that the join deals both sides anew and can split a span that very many texts share.
    first = stored(first.select(F.col("span").alias("s"), "origin"), "span-firsts")
    later = places.join(first, F.col("span") == F.col("s")).filter(_place() != F.col("origin"))
    cuts = stored(
        later.groupBy("none", "doc", "text_id").agg(F.collect_set("at").alias("cuts")), "span-cuts"
    ).withColumnsRenamed({"none": "x", "doc": "d", "text_id": "t"})
    same = (F.col("none") == F.col("x")) & (F.col("doc") == F.col("d")) & (F.col("text_id") == F.col("t"))
    joined = _keyed(docs, "doc_id").join(cuts, same, "left").select("doc_id", "text", "cuts")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())]
    )

    def result(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        spans = Spans()
        for part in parts:
            for doc, text, found in zip(*part.columns, strict=True):
                doc, text = doc.as_py(), text.as_py()
                yield (doc, *_without(text, found.as_py() or [], spans)) if text else (doc, text, 0, 0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(result(parts), schema)

    return joined.mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long")
