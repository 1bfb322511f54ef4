"""Substring de-duplication by a hash-compared suffix sort.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts elsewhere.

1. Anchors. Every window of ``WINDOW`` bytes names one of the ``GRAM``-byte strings
   within it, the one with the least hash (the first of equal ones). Equal windows
   name the same one at the same place, so they can only meet at equal anchors, of
   which there is one in about 70 bytes. Neighbouring windows with the same anchor
   make a row; prefix polynomial hashes give the hash of the anchor and of the row's
   whole span.
2. Rows whose anchor occurs once are left out (a Bloom filter of the anchors that
   occur again is broadcast; it lets some through, which changes nothing). Rows with
   equal spans are repeated as a whole; only one of each span goes on.
3. Different spans around the same anchor are sorted, from the anchor forwards and
   from the anchor backwards, by mergesort: two suffixes are compared at the end of
   their common extension, which binary search finds on prefix hashes in a number of
   steps that is the logarithm of its length. Both orders and the common lengths of
   neighbours tell which windows have the same bytes on both sides of the anchor.
   Common lengths are compared byte by byte; a collision repeats the sort with other
   hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import bloom
from hearthline.llm.common import batches, prepare, stored

#: Bytes that are repeated, and bytes of an anchor.
WINDOW, GRAM = 200, 64
#: Different spans of one anchor that are sorted together; beyond, windows meet by their hash.
SORTED = 4096
#: Spans that a task sorts at a time (whole anchors, so ``SORTED`` more at most).
TOGETHER = 2000

#: Bytes of a text that are looked through at a time.
_BITS = 20
_BLOCK = 1 << _BITS
_GRAMS = WINDOW - GRAM + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


class Polynomial:
    """Prefix hashes modulo 2**64: every byte has a random value, every place a power of an odd base."""

    def __init__(self, size: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
        self.power = self._powers(base, size)
        self.inverse = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from ``start`` to ``end``, wherever they lie."""
        return (prefix[end] - prefix[start]) * self.inverse[start]


class Scanner:
    """Rows of windows with the same anchor."""

    def __init__(self) -> None:
        self.grams, self.spans = Polynomial(_BLOCK, 1), Polynomial(_BLOCK, 2)

    def __call__(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, span, first byte, windows and place of the anchor) of the windows of each block."""
        data = np.frombuffer(text, np.uint8)
        step = _BLOCK - WINDOW + 1
        for start in range(0, len(data) - WINDOW + 1, step):
            gram, span, low, size, off = self.block(data[start : start + _BLOCK])
            yield gram, span, low + start, (size << 8) | off

    def block(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        n, m = len(data), len(data) - GRAM + 1
        prefix = self.grams.prefixes(data)
        gram = _mixed((prefix[GRAM:] - prefix[:m]) * self.grams.inverse[:m])
        # Hash and place in one number: the least is the first of the least.
        least = (gram & ~np.uint64(_BLOCK - 1)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= _GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        windows = n - WINDOW + 1
        least = np.minimum(least[:windows], least[_GRAMS - width :][:windows])
        anchor = (least & np.uint64(_BLOCK - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor))
        low, high = np.append(0, cut + 1), np.append(cut, windows - 1)
        anchor = anchor[low]
        size, off = high - low, anchor - low
        other = self.spans.prefixes(data)
        span = _mixed(self.spans.of(other, low, high + WINDOW) + _mixed(((size << 8) | off).astype(np.uint64)))
        return gram[anchor], span, low, size, off


def _once_more(gram: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Rows of a block that have two equal ones before them."""
    order = np.lexsort((span, gram))
    same = (gram[order[1:]] == gram[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
    out = np.zeros(len(gram), bool)
    out[order[2:]] = same[1:] & same[:-1]
    return out


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc, text_id, text): rows with the same first two have the same text, null as empty."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        *more, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text")
    )


def _anchors(keyed: DataFrame) -> DataFrame:
    """(shard, hash): the anchors of all rows, two of equal ones of a block at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for part in parts:
            found = [np.zeros(0, np.uint64)]
            for text in part.column(0):
                for gram, span, _, _ in scan(text.as_py()):
                    found.append(gram[~_once_more(gram, span)])
            grams = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["hash"])

    seen = keyed.filter(F.length("text") >= WINDOW).select("text").mapInArrow(run, "hash long")
    again = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return again.select(F.lit(0).alias("shard"), "hash")


def _rows(keyed: DataFrame, again: np.ndarray | None) -> DataFrame:
    """(doc, text_id, gram, span, at) of rows whose anchor may occur again.

    ``at`` packs first byte, windows less one, and place of the anchor. Rows that
    have two equal ones before them in their block need no company: their gram is
    null and ``at`` packs the first and last byte of several such rows in a row.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(again)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for part in parts:
            docs, texts = part.column(0).to_numpy(), part.column(1).to_numpy()
            which, grams, spans, places, alone = [], [], [], [], []
            for i, text in enumerate(part.column(2)):
                for gram, span, low, packed in scan(text.as_py()):
                    more = _once_more(gram, span)
                    if more.any():
                        at = np.flatnonzero(more)
                        cut = np.flatnonzero(np.diff(at) != 1)
                        first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
                        ends = low[last] + (packed[last] >> 8) + WINDOW
                        which.append(np.full(len(first), i))
                        grams.append(np.zeros(len(first), np.uint64))
                        spans.append(np.zeros(len(first), np.uint64))
                        places.append((low[first] << 32) | ends)
                        alone.append(np.ones(len(first), bool))
                    keep = bloom.held(shared.value, gram) & ~more
                    which.append(np.full(int(keep.sum()), i))
                    grams.append(gram[keep])
                    spans.append(span[keep])
                    places.append((low[keep] << 16) | packed[keep])
                    alone.append(np.zeros(len(which[-1]), bool))
            if which:
                which = np.concatenate(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[which]),
                        pa.array(texts[which]),
                        pa.array(np.concatenate(grams).view(np.int64), mask=np.concatenate(alone)),
                        pa.array(np.concatenate(spans).view(np.int64)),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["doc", "text_id", "gram", "span", "at"],
                )

    return keyed.filter(F.length("text") >= WINDOW).mapInArrow(
        run, "doc long, text_id long, gram long, span long, at long"
    )


def _likely(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose text may be among those wanted."""
    shared = keyed.sparkSession.sparkContext.broadcast(
        bloom.build(wanted.select(F.lit(0).alias("shard"), F.col("text_id").alias("hash"))).get(0)
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = bloom.held(shared.value, part.column("text_id").to_numpy().view(np.uint64))
            yield part.filter(pa.array(keep))

    return keyed.mapInArrow(run, keyed.schema)


def merge_sort(n: int, compare: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Order of the numbers below ``n``; ``compare`` gives the signs of many comparisons at once.

    Runs are merged in pairs, all pairs of a round together: every element looks
    for its place in the other run by binary search.
    """
    order, width = np.arange(n), 1
    place = np.arange(n)
    while width < n:
        start = place // (2 * width) * (2 * width)
        middle, end = np.minimum(start + width, n), np.minimum(start + 2 * width, n)
        first = place < middle
        low, high = np.where(first, middle, start), np.where(first, end, middle)
        other = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            half = (low[open_] + high[open_]) // 2
            sign = compare(order[open_], order[half])
            behind = (sign > 0) | ((sign == 0) & ~first[open_])
            low[open_] = np.where(behind, half + 1, low[open_])
            high[open_] = np.where(behind, high[open_], half)
        own = np.where(first, place - start, place - middle)
        out = np.empty_like(order)
        out[start + own + (low - other)] = order
        order, width = out, width * 2
    return order


class Suffixes:
    """Sorted suffixes of several strings, each from its start to its end, within groups."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.length, self.group = data, start, end - start, group
        for seed in range(3, 64):
            self.hashes = Polynomial(len(data) + 1, seed)
            self.prefix = self.hashes.prefixes(data)
            self.order = merge_sort(len(start), self.compare)
            a, b = self.order[:-1], self.order[1:]
            self.common = np.where(group[a] == group[b], self.extension(a, b), 0)
            if self.verified(a, b):
                return
        raise RuntimeError("every hash function collides")

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes each, by binary search on prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        x, y = self.start[a], self.start[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            half = (low + high + 1) // 2
            same = self.hashes.of(self.prefix, x, x + half) == self.hashes.of(self.prefix, y, y + half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.sign(self.group[a] - self.group[b])
        open_ = np.flatnonzero(out == 0)
        a, b = a[open_], b[open_]
        common = self.extension(a, b)
        over_a, over_b = common == self.length[a], common == self.length[b]
        last = len(self.data) - 1
        byte_a = self.data[np.minimum(self.start[a] + common, last)].astype(np.int64)
        byte_b = self.data[np.minimum(self.start[b] + common, last)].astype(np.int64)
        out[open_] = np.sign(np.where(over_a, -1, byte_a) - np.where(over_b, -1, byte_b))
        return out

    def verified(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether neighbours have their common bytes, byte by byte, and differ or end behind them."""
        total = int(self.common.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(self.common) - self.common, self.common)
        same = self.data[np.repeat(self.start[a], self.common) + inside] == self.data[np.repeat(self.start[b], self.common) + inside]
        return bool(same.all())

    def longest(self) -> np.ndarray:
        """The longest common prefix of each suffix with another one."""
        out = np.zeros(len(self.start), np.int64)
        out[self.order[:-1]] = self.common
        out[self.order[1:]] = np.maximum(out[self.order[1:]], self.common)
        return out

    def classes(self, depth: int) -> np.ndarray:
        """Number of the class of suffixes with the same ``depth`` bytes, for each."""
        out = np.empty(len(self.start), np.int64)
        out[self.order] = np.append(0, np.cumsum((self.common < depth) | (np.diff(self.group[self.order]) != 0)))
        return out


def repeated_windows(
    pieces: list[bytes], group: np.ndarray, size: np.ndarray, off: np.ndarray
) -> list[tuple[int, int]]:
    """(piece, window) of the windows that another piece of the same group has too.

    A piece is the span of ``size`` windows around an anchor that lies ``off``
    bytes from its start; the windows of a piece start at 0 to ``size - 1``.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    end = np.cumsum(lengths)
    start = end - lengths
    forward = Suffixes(data, start + off, end, group)
    backward = Suffixes(data[::-1], len(data) - (start + off), len(data) - start, group)
    # ``left`` bytes of a window lie before the anchor.
    low = np.maximum(off - size + 1, WINDOW - forward.longest())
    high = np.minimum(off, backward.longest())
    out = []
    for left in range(int(max(low.min(initial=WINDOW), 0)), int(high.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= left) & (left <= high))
        if len(own) < 2:
            continue
        both = forward.classes(WINDOW - left)[own] * len(group) + backward.classes(left)[own]
        _, index, times = np.unique(both, return_inverse=True, return_counts=True)
        out += [(int(i), int(off[i]) - left) for i in own[times[index] > 1]]
    return out


def _sorted_cuts(pieces: DataFrame) -> DataFrame:
    """(doc, text_id, start, end) from pieces of anchors with few spans."""
    schema = pa.schema([("doc", pa.int64()), ("text_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def close(held: list[tuple]) -> Iterator[tuple]:
        grams, _, _, at, bodies = zip(*held)
        at = np.array(at)
        found = repeated_windows(
            list(bodies), np.unique(np.array(grams), return_inverse=True)[1], ((at >> 8) & 255) + 1, at & 255
        )
        windows = np.array(sorted(found), np.int64).reshape(-1, 2)
        breaks = np.flatnonzero((np.diff(windows[:, 0]) != 0) | (np.diff(windows[:, 1]) != 1))
        for first, last in zip(np.append(0, breaks + 1), np.append(breaks, len(windows) - 1)) if len(windows) else ():
            _, doc, text_id, place, _ = held[windows[first, 0]]
            yield doc, text_id, (place >> 16) + int(windows[first, 1]), (place >> 16) + int(windows[last, 1]) + WINDOW

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for part in parts:
            for row in zip(*[part.column(i).to_pylist() for i in range(5)], strict=True):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield from close(held)
                    held = []
                held.append(row)
        if held:
            yield from close(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(parts), schema, size=10_000)

    dealt = pieces.select("gram", "doc", "text_id", "at", "body").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "doc long, text_id long, start long, end long")


def _hashed_cuts(pieces: DataFrame) -> DataFrame:
    """The same from pieces of anchors with very many spans: windows meet by two hashes each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Polynomial(2 * WINDOW, 1), Polynomial(2 * WINDOW, 2)
        for part in parts:
            for doc, text_id, at, body in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                data = np.frombuffer(body, np.uint8)
                starts = np.arange(((at >> 8) & 255) + 1)
                values = [pa.array(_mixed(p.of(p.prefixes(data), starts, starts + WINDOW)).view(np.int64)) for p in (one, two)]
                same = [pa.array(np.full(len(starts), v, np.int64)) for v in (doc, text_id)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts + (at >> 16)), *values], names=["doc", "text_id", "start", "one", "two"])

    windows = stored(
        pieces.select("doc", "text_id", "at", "body").mapInArrow(run, "doc long, text_id long, start long, one long, two long"),
        "hot-windows",
    )
    again = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two")
    return windows.join(again, ["one", "two"]).select("doc", "text_id", "start", (F.col("start") + WINDOW).alias("end"))


def _bodies(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (gram, doc, text_id, at) with the bytes of their spans."""
    text = (
        _likely(keyed, wanted.select("text_id").distinct())
        .dropDuplicates(["doc", "text_id"])
        .select(F.col("doc").alias("d"), F.col("text_id").alias("t"), "text")
    )
    each = wanted.groupBy("doc", "text_id").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("rows"))
    joined = text.join(each, (F.col("d") == F.col("doc")) & (F.col("t") == F.col("text_id")))
    schema = pa.schema(
        [("gram", pa.int64()), ("doc", pa.int64()), ("text_id", pa.int64()), ("at", pa.int64()), ("hot", pa.bool_()), ("body", pa.binary())]
    )

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc, text_id, text, found in zip(*part.columns, strict=True):
                doc, text_id, text = doc.as_py(), text_id.as_py(), text.as_py()
                for row in found.as_py():
                    start = row["at"] >> 16
                    yield row["gram"], doc, text_id, row["at"], row["hot"], text[start : start + ((row["at"] >> 8) & 255) + WINDOW]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(parts), schema, size=10_000)

    return joined.select("doc", "text_id", "text", "rows").mapInArrow(
        run, "gram long, doc long, text_id long, at long, hot boolean, body binary"
    )


def _cuts(keyed: DataFrame, together: int) -> DataFrame:
    """(doc, text_id, start, end): bytes to remove, overlapping."""
    shard = bloom.build(stored(_anchors(keyed), "anchors-again")).get(0)
    rows = stored(_rows(keyed, shard), "anchor-rows")
    spans = stored(
        rows.filter("gram is not null")
        .groupBy("gram", "span")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "text_id", "at")).alias("one")),
        "anchor-spans",
    )

    def range_(frame: DataFrame, start: Column, end: Column) -> DataFrame:
        return frame.select("doc", "text_id", start.alias("start"), end.alias("end"))

    first = F.shiftright("at", 16)
    last = first + F.shiftright("at", 8).bitwiseAND(255) + WINDOW
    alone = range_(rows.filter("gram is null"), F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFFFFFF))
    whole = range_(rows.join(spans.filter("n > 1").select("gram", "span"), ["gram", "span"]), first, last)
    several = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1")
    wanted = spans.join(several, "gram").select("gram", "one.*", (F.col("spans") > together).alias("hot"))
    pieces = stored(_bodies(keyed, stored(wanted, "anchor-wanted")), "anchor-pieces")
    return (
        alone.unionByName(whole)
        .unionByName(_sorted_cuts(pieces.filter("not hot")))
        .unionByName(_hashed_cuts(pieces.filter("hot")))
    )


def _without(text: bytes, cuts: list[int]) -> tuple[bytes, list[dict[str, int]]]:
    """What is left, and the maximal removed runs; a cut packs its start and end."""
    spans: list[list[int]] = []
    for cut in sorted(cuts):
        start, end = cut >> 32, cut & 0xFFFFFFFF
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept), [{"start": a, "length": b - a} for a, b in spans]


def deduplicate(docs: DataFrame, together: int = SORTED) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs``.

    ``spans`` (start, length) are the maximal runs of bytes that are removed, by
    start; ``kept`` is the rest, as bytes (a cut may part a character). No first
    occurrence stays. Every row is a text of its own: rows that repeat an id, or
    have none, count as elsewhere, so exact copies of ``WINDOW`` bytes go whole.
    Null and empty texts have no bytes and no spans. An empty table gives no rows;
    other columns are not looked at. ``together`` is the number of spans of one
    anchor that are sorted in one task; anchors with more are compared by window.
    """
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    each = stored(
        _cuts(keyed, together)
        .groupBy("doc", "text_id")
        .agg(F.collect_set(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("cuts"))
        .select(F.col("doc").alias("d"), F.col("text_id").alias("t"), "cuts"),
        "byte-cuts",
    )
    joined = _keyed(docs, "doc_id").join(each, (F.col("doc") == F.col("d")) & (F.col("text_id") == F.col("t")), "left")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())]
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc, text, cuts in zip(*part.columns, strict=True):
                text = text.as_py()
                kept, spans = _without(text, cuts.as_py() or [])
                yield doc.as_py(), len(text), spans, kept

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(cut(parts), schema)

    return joined.select("doc_id", "text", "cuts").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
    )
