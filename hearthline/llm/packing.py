"""Lexical retrieval packing.

Documents are cut into token pieces; pieces that share their most telling token
lie together and are cut into shards of bounded size. Each shard has an inverted
index with BM25 weights (document frequencies and mean length are those of the
whole corpus). A seed opens a window; its nearest unused neighbours by BM25 fill
it up. The piece that does not fit is cut, and its rest seeds the next window.
What is left of a shard at its end goes to sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import batches, prepare, stored, texts

WINDOW = 4096
END_ID = 2
#: Tokens of one piece of a long document, and of one shard.
SEGMENT = 16 * WINDOW
SHARD = 512 * WINDOW
#: Pieces of one shard, should they be very short.
SHARD_PIECES = 8192
#: Places for parts of texts whose ids a worker remembers (a power of two), and the share of them
#: that is filled; longer parts than ``PART_LENGTH`` are not remembered.
PLACES, FILLED, PART_LENGTH = 1 << 21, 0.6, 16
#: Characters of plain texts (one text at least) that are parted at a time.
TOGETHER = 1 << 19
#: One piece in so many is looked at to balance shards.
ESTIMATED = 16
#: Neighbours of a seed that are sorted at first.
NEAREST = 64
K1, B = 1.2, 0.75
VOCABULARY = 1 << 16

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
        ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)


# Fixed by the tokenizer: how it parts lower-cased text of the first 256 characters
# (letters, single digits, marks, and the endings of contractions).
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters only are parted here; all others go to the tokenizer whole.
_PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
_SPACE, _MARK, _NUMBER, _ALPHA = range(4)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the first 256 characters its lower case and its kind."""
    every = [chr(c) for c in range(256)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 and ord(x) < 256 else ord(c) for c in every], np.uint8)
    kinds = ((r"\s", _SPACE), (f"[{_DIGIT}]", _NUMBER), (f"[{_LETTER}]", _ALPHA))
    return lower, np.array([next((k for p, k in kinds if re.match(p, c)), _MARK) for c in every], np.uint8)


_LOWER, _KIND = _tables()


def _parts(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts begin and end in lower-cased plain texts that lie end to end, cut at the given places."""
    kind = _KIND[data]
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    first = np.zeros(len(data) + 1, bool)
    first[cuts] = True
    begins |= first[:-1]
    # An apostrophe that no mark precedes takes the ending of a contraction with it.
    at = np.flatnonzero((data == ord("'")) & begins)
    if len(at):
        one, two = np.concatenate([data, np.zeros(2, np.uint8)])[at[:, None] + [1, 2]].T
        near, far = first[at + 1], first[np.minimum(at + 2, len(data))]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~near
        pair = one.astype(np.int64) * 256 + two
        long = np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~near & ~far
        begins[at[short | long] + 1] = False
        for hit, size in ((short, 2), (long, 3)):
            after = at[hit] + size
            after = after[after < len(data)]
            begins[after] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    words = kind[starts] != _SPACE
    return starts[words], ends[words]


class Parts:
    """Ids of the parts of lower-cased texts by the tokenizer's own model, remembered.

    A part of up to 16 characters is known by all of them, as two numbers; what came
    first stays, and frequent parts are among it. Many parts are looked up at a time.
    """

    def __init__(self, tokenizer: object) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: as_bytes(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.low, self.high = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.start, self.size = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.uint8)
        self.pool, self.used, self.filled = np.zeros(1 << 16, "<u4"), 0, 0

    def __len__(self) -> int:
        return self.filled

    def learned(self, part: bytes) -> list[int]:
        text = part.decode("latin-1")
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.spelled))]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and their number for each part."""
        padded = np.concatenate([data, np.zeros(PART_LENGTH, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        size = ends - starts
        low = eight[starts] & masks[np.minimum(size, 8)]
        high = eight[starts + 8] & masks[np.clip(size - 8, 0, 8)]
        mixed = (low ^ (high * _MULTIPLY) ^ (high >> np.uint64(29))) * _MULTIPLY
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MULTIPLY
        bits = PLACES.bit_length() - 1
        first = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        second = (mixed & np.uint64(PLACES - 1)).astype(np.int64)
        short = size <= PART_LENGTH
        place = np.where((self.low[first] == low) & (self.high[first] == high), first, second)
        known = short & (self.low[place] == low) & (self.high[place] == high)
        at, count = self.start[place].astype(np.int64), self.size[place].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            # Equal parts are learned once; all their ids follow the pool, for this call.
            raw, fresh = data.tobytes(), []
            once: dict[bytes, int] = {}
            which, offsets = [], [0]
            for a, b in zip(starts[new].tolist(), ends[new].tolist()):
                part = raw[a:b]
                number = once.setdefault(part, len(once))
                if number == len(offsets) - 1:
                    fresh.extend(self.learned(part))
                    offsets.append(len(fresh))
                which.append(number)
            learned, offset = np.array(fresh, "<u4"), np.array(offsets)
            at[new], count[new] = offset[which] + self.used, np.diff(offset)[which]
            pool = np.concatenate([self.pool[: self.used], learned])
        else:
            pool = self.pool
        ids = _gathered(pool, at, count)
        if len(new):
            _, some = np.unique(which, return_index=True)
            some = new[some]
            some = some[short[some] & (count[some] < 256)]
            self._remember(low[some], high[some], [first[some], second[some]], pool, at[some], count[some])
        return ids, count

    def _remember(
        self, low: np.ndarray, high: np.ndarray, places: list[np.ndarray], pool: np.ndarray, at: np.ndarray, count: np.ndarray
    ) -> None:
        """Keep new parts in the first of their places that is free."""
        while places:
            place = places[0]
            free = np.flatnonzero(self.low[place] == 0)
            _, some = np.unique(place[free], return_index=True)
            some = free[some][: max(0, int(FILLED * PLACES) - self.filled)]
            own, n = place[some], count[some]
            ids = _gathered(pool, at[some], n)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), "<u4")])
            self.pool[self.used : self.used + len(ids)] = ids
            self.low[own], self.high[own] = low[some], high[some]
            self.start[own], self.size[own] = self.used + np.cumsum(n) - n, n
            self.used += len(ids)
            self.filled += len(some)
            left = np.ones(len(low), bool)
            left[some] = False
            low, high, at, count = low[left], high[left], at[left], count[left]
            places = [p[left] for p in places[1:]]


def _gathered(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` values of the pool from each of the places on, one after the other."""
    total = np.cumsum(count)
    return pool[np.repeat(at - total + count, count) + np.arange(total[-1] if len(total) else 0)]


def _forget() -> None:
    """Free the parts that this worker remembers; its process goes on to other tasks and operators."""
    sys.modules.pop("hearthline_worker", None)


class Encoder:
    """Token ids of whole texts, for the tokenizer whose parts ``_PART`` names.

    The parts of a text are encoded one by one whatever stands beside them, and
    they come again and again, so their ids are remembered, within a bound.
    """

    def __init__(self, path: str) -> None:
        # Spark runs as many tasks as there are cores; threads below them only get in the way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # A Python worker runs many tasks; what it has learned outlives each of them, until
        # the tasks that count the ids of the finished table free it.
        kept = sys.modules.setdefault("hearthline_worker", ModuleType("hearthline_worker")).__dict__
        if path not in kept:
            tokenizer = Tokenizer.from_file(path)
            kept[path] = (tokenizer, Parts(tokenizer))
        self.tokenizer, self.known = kept[path]
        # Only a tokenizer that parts text in this way may be given parts.
        sample = "AB'll c9\xb2 \xdf\xc9.,'s"
        self.by_parts = self.joined([sample])[0].tolist() == [*self.encoded(sample), END_ID]

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def joined(self, plain: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, ``END_ID`` appended to each."""
        data = _LOWER[np.frombuffer("".join(plain).encode("latin-1"), np.uint8)]
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
        starts, ends = _parts(data, cuts)
        ids, count = self.known(data, starts, ends)
        places = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, cuts)].tolist()
        return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(places, places[1:])]

    def all(self, some: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of every text in turn, ``END_ID`` appended; plain ones are parted together."""
        held: list[str] = []
        size = 0
        for text in some:
            plain = self.by_parts and "<|" not in text and _PLAIN.fullmatch(text)
            if held and (not plain or size + len(text) > TOGETHER):
                yield from self.joined(held)
                held, size = [], 0
            if plain:
                held.append(text)
                size += len(text)
            else:
                # Lone surrogates cannot reach the tokenizer; Spark's strings hold none.
                yield np.array([*self.encoded(text.encode("utf-8", "replace").decode()), END_ID], "<u4")
        if held:
            yield from self.joined(held)

    def __call__(self, text: str) -> np.ndarray:
        """Ids of the text, ``END_ID`` appended."""
        return next(self.all([text]))


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents: (doc_id, start, doc_tokens, ids as two bytes each)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = Encoder(tokenizer)
        for part in parts:
            for doc, ids in zip(part.column(0).to_pylist(), encode.all(texts(part.column(1))), strict=True):
                if ids.max() >= VOCABULARY:
                    raise ValueError("token ids beyond two bytes")
                for start in range(0, len(ids), SEGMENT):
                    piece = ids[start : start + SEGMENT].astype("<u2").tobytes()
                    yield doc, start, len(ids), piece

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(parts), schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, doc_tokens long, ids binary"
    )


def _frequencies(pieces: DataFrame) -> np.ndarray:
    """Pieces that contain each token id; its last entry is the number of pieces.

    Every task counts in one array of the size of the vocabulary; sums per id
    meet in Spark, and at most ``VOCABULARY`` numbers reach the driver.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        seen = np.zeros(VOCABULARY + 2, np.int64)
        last = np.zeros(VOCABULARY, np.int64)
        places = np.arange(SEGMENT)
        for part in parts:
            for value in part.column(0):
                ids = np.frombuffer(value.as_py(), "<u2")
                # Each distinct id counts at its last place only.
                at = places[: len(ids)]
                last[ids] = at
                seen[ids[last[ids] == at]] += 1
                seen[VOCABULARY] += 1
                seen[VOCABULARY + 1] += len(ids)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], names=["id", "n"])

    counted = pieces.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(VOCABULARY + 2, np.int64)
    for row in counted.collect():
        out[row["id"]] = row["n"]
    return out


class Weights:
    """BM25 with the statistics of the whole corpus."""

    def __init__(self, seen: np.ndarray) -> None:
        pieces, tokens = max(int(seen[VOCABULARY]), 1), int(seen[VOCABULARY + 1])
        n = seen[:VOCABULARY]
        self.rarity = np.log1p((pieces - n + 0.5) / (n + 0.5)).astype(np.float32)
        self.mean = max(tokens / pieces, 1.0)
        # A token that no other piece has leads to no neighbour.
        self.telling = np.where(n > 1, self.rarity, 0).astype(np.float32)

    def of(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids of all pieces in turn, the number of their piece and their weights in it; where pieces begin."""
        sizes = np.array([len(ids) for ids in pieces])
        keys = np.repeat(np.arange(len(pieces)) << 16, sizes)
        keys |= np.concatenate(pieces)
        keys.sort()
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(heads, len(keys)))
        owner, terms = keys[heads] >> 16, keys[heads] & (VOCABULARY - 1)
        damp = (K1 * (1 - B + B * sizes / self.mean))[owner]
        weights = self.rarity[terms] * (times * (K1 + 1) / (times + damp)).astype(np.float32)
        return terms, owner, weights, np.searchsorted(owner, np.arange(len(pieces)))

    def anchors(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The two ids that tell most about each piece, smaller ids first among equals; one id alone stands twice."""
        terms, owner, weights, start = self.of(pieces)
        weights = np.where(self.telling[terms] > 0, weights, 0)
        found = []
        for _ in range(2):
            hit = np.flatnonzero(weights == np.maximum.reduceat(weights, start)[owner])
            best = hit[np.searchsorted(hit, start)]
            found.append(terms[best])
            weights[best] = -1
        return found[0], found[1]


def _anchored(pieces: DataFrame, seen: np.ndarray) -> DataFrame:
    """Pieces with the two tokens that tell most about each, as their place in the order."""
    shared = pieces.sparkSession.sparkContext.broadcast(seen)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        known = Weights(shared.value)
        for part in parts:
            if not part.num_rows:
                continue
            first, second = known.anchors([np.frombuffer(value.as_py(), "<u2") for value in part.column("ids")])
            places = first * VOCABULARY + second
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(places, pa.int64())], names=[*part.schema.names, "place"]
            )

    return pieces.mapInArrow(
        run, "doc_id long, start long, doc_tokens long, ids binary, place long"
    )


def _sharded(pieces: DataFrame, seen: np.ndarray, shards: int) -> DataFrame:
    """Pieces with their ``place``, ``tie`` and ``shard``, about ``shards`` shards of equal size.

    One piece in ``ESTIMATED`` (by hash) tells how many tokens each first anchor
    has; neighbouring anchors make up a shard, and an anchor that is larger than a
    shard has several, among which its pieces are dealt by hash. The estimate
    only balances shards, and is the same in every run.
    """
    pieces = pieces.withColumn("tie", F.xxhash64("doc_id", "start"))
    if shards < 2:
        return _anchored(pieces.drop("tie"), seen).select("*", F.xxhash64("doc_id", "start").alias("tie"), F.lit(0).alias("shard"))
    some = _anchored(pieces.filter(F.pmod("tie", F.lit(ESTIMATED)) == 0).drop("tie"), seen)
    sizes = np.zeros(VOCABULARY, np.int64)
    first = F.shiftright("place", 16)
    for row in some.groupBy(first.alias("first")).agg(F.sum(F.length("ids")).alias("size")).collect():
        sizes[row["first"]] = row["size"]
    target = max(1.0, float(sizes.sum()) / shards)
    several = np.maximum(1, np.ceil(sizes / target)).astype(np.int64)
    start = np.floor(np.cumsum(np.where(several > 1, 0, sizes)) / target).astype(np.int64)
    # Anchors with shards of their own have them behind all others.
    own = np.flatnonzero(several > 1)
    start[own] = int(start.max()) + 1 + np.cumsum(several[own]) - several[own]
    table = pieces.sparkSession.createDataFrame(
        [(int(i), int(start[i]), int(several[i])) for i in np.flatnonzero(sizes)], "anchor int, shard_start int, shard_count int"
    )
    anchored = _anchored(pieces.drop("tie"), seen).withColumn("tie", F.xxhash64("doc_id", "start"))
    joined = anchored.join(F.broadcast(table), first == F.col("anchor"), "left")
    dealt = F.col("shard_start") + F.pmod(F.xxhash64("tie"), F.col("shard_count")).cast("int")
    return joined.withColumn("shard", F.coalesce(dealt, (first % shards).cast("int"))).drop("anchor", "shard_start", "shard_count")


class Shard:
    """An inverted index over the pieces of one shard, and the packing of them."""

    def __init__(self, pieces: list[tuple[int, int, int, np.ndarray]], weights: Weights) -> None:
        self.pieces = pieces
        term, owner, value, begin = weights.of([ids for _, _, _, ids in pieces])
        self.terms = np.split(term, begin[1:])
        order = np.argsort(term, kind="stable")
        self.owner, self.value = owner[order].astype(np.int32), value[order]
        self.start = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.unused = np.ones(len(pieces), bool)
        self.indexed = len(pieces)

    def _shrink(self) -> None:
        """Leave used pieces out of the index."""
        keep = self.unused[self.owner]
        self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
        self.owner, self.value = self.owner[keep], self.value[keep]
        self.indexed = int(self.unused.sum())

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused pieces by falling BM25 score against the seed, ties in the shard's order.

        The nearest ones are sorted first; the others only if those do not do.
        """
        left = int(self.unused.sum())
        if 2 * left < self.indexed:
            self._shrink()
        t = self.terms[seed]
        lists = list(zip(self.start[t].tolist(), self.start[t + 1].tolist(), strict=True))
        owner = np.concatenate([self.owner[a:b] for a, b in lists])
        value = np.concatenate([self.value[a:b] for a, b in lists])
        scores = np.bincount(owner, weights=value, minlength=len(self.pieces))
        scores[~self.unused] = -1
        bound = 0.0
        if left > NEAREST:
            bound = np.partition(scores, len(scores) - NEAREST)[len(scores) - NEAREST]
        for found in (scores >= bound, (scores < bound) & (scores >= 0)):
            near = np.flatnonzero(found)
            yield from near[np.argsort(-scores[near], kind="stable")].tolist()

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of (piece, from, to); all full but those at the end."""
        window: list[tuple[int, int, int]] = []
        room, following = WINDOW, 0
        rest: tuple[int, int] | None = None  # a cut piece and where it goes on
        while True:
            if rest is None:
                while following < len(self.pieces) and not self.unused[following]:
                    following += 1
                if following == len(self.pieces):
                    break
                seed, begin = following, 0
                self.unused[seed] = False
            else:
                (seed, begin), rest = rest, None
            size = len(self.pieces[seed][3])
            take = min(room, size - begin)
            window.append((seed, begin, begin + take))
            room -= take
            if begin + take < size:
                rest = (seed, begin + take)
            elif room:
                for near in self.neighbours(seed):
                    self.unused[near] = False
                    size = len(self.pieces[near][3])
                    take = min(room, size)
                    window.append((near, 0, take))
                    room -= take
                    if take < size:
                        rest = (near, take)
                    if not room:
                        break
            if not room:
                yield window
                window, room = [], WINDOW
        yield from _powers(window)


def _powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut the last, partly filled window into sequences whose lengths are powers of two."""
    left = sum(end - begin for _, begin, end in window)
    part: list[tuple[int, int, int]] = []
    room = 1 << (left.bit_length() - 1) if left else 0
    for piece, begin, end in window:
        while begin < end:
            take = min(room, end - begin)
            part.append((piece, begin, begin + take))
            begin, room, left = begin + take, room - take, left - take
            if not room:
                yield part
                part, room = [], 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece, the pieces of a
    sequence join without gaps from offset 0, and a sequence has ``WINDOW`` ids
    or a power of two. ``with_ids`` adds the ids (little-endian, four bytes
    each). Null and empty texts are documents of the end id alone; rows that
    repeat an id are packed like any other rows, null ids too. An empty table
    gives no rows. Reruns on the same table agree.
    """
    spark = prepare(docs.sparkSession)
    pieces = stored(tokenized(docs, tokenizer), "tokens")
    seen = _frequencies(pieces)
    shards = max(1, round(int(seen[VOCABULARY + 1]) / (4 * SHARD)))
    ordered = (
        _sharded(pieces, seen, shards)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "place", "tie", "doc_id", "start", "doc_tokens", F.crc32("ids"))
    )
    counts = spark.sparkContext.broadcast(seen)
    columns = PIECES.names if with_ids else PIECES.names[:-1]

    def packed(held: list[tuple], weights: Weights, number: Iterator[int]) -> Iterator[tuple]:
        for window in Shard(held, weights).sequences():
            sequence, offset = next(number), 0
            for piece, begin, end in window:
                doc, start, total, ids = held[piece]
                raw = ids[begin:end].astype("<u4").tobytes()
                row = (doc, start + begin, end - begin, zlib.crc32(raw), total, sequence, offset)
                yield (*row, raw) if with_ids else row
                offset += end - begin

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        weights, now, numbers = Weights(counts.value), None, iter(())
        held: list[tuple] = []
        size = 0
        for part in parts:
            lists = [part.column(i).to_pylist() for i in range(4)]
            for shard, doc, start, total, value in zip(*lists, part.column(4), strict=True):
                if held and (shard != now or size >= SHARD or len(held) >= SHARD_PIECES):
                    yield from packed(held, weights, numbers)
                    held, size = [], 0
                if shard != now:
                    # A shard lies in one task, so its numbers are its own wherever that runs.
                    now, numbers = shard, iter(range(shard << 40, (shard + 1) << 40))
                ids = np.frombuffer(value.as_py(), "<u2")
                held.append((doc, start, total, ids))
                size += len(ids)
        if held:
            yield from packed(held, weights, numbers)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        fields = pa.schema([PIECES.field(c) for c in columns])
        yield from batches(rows(parts), fields, size=5000)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.select("shard", "doc_id", "start", "doc_tokens", "ids").mapInArrow(
        run, kinds + (", ids binary" if with_ids else "")
    )
