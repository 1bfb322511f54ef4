"""N-gram Jaccard join by prefixes of token combinations.

Tokens are hashed shingles; a class of documents is a distinct set of them.
A set of n tokens can only be linked with sets that miss at most
m = n - ceil(t n) of its tokens. Three filters follow from this, none of which
can lose a link:

1. Reduced sets. Of every set only the first 2m + 1 tokens in hash order go
   through the global count. Two linked sets share at least m + 1 of these (m
   of the smaller one), so a set with fewer tokens that occur elsewhere is done.
2. Prefixes. The reduced set is ordered from rare to frequent. Linked sets share
   at least K + 1 tokens of their prefixes when these are extended by K tokens.
   Rare tokens are indexed one by one; the frequent ones fall into K classes,
   and pairs of one class are indexed: among K + 1 shared frequent tokens, two
   lie in one class. K grows with the length of the set, so the number of pairs
   grows like the number of tokens.
3. Candidates of one index entry are compared with a hub of the entry first.
   What is linked to it is connected; only pairs between different components
   are left for a last, complete round.
4. Sketches. A sketch has one bit per class of tokens, the parity of their number.
   Sets whose sketches differ in d bits differ in d tokens or more. After the hubs,
   sketches are compared within an entry, in blocks of bounded size: first every set
   names its nearest ones of other components that may be linked, which joins
   nearly all of a family of copies; then all pairs that may be linked and are
   still in different components are handed on.

Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import batches, prepare, scalar, stored
from hearthline.llm.components import components

#: A token in more sets than this is frequent.
RARE = 64
#: Tokens of a set per class of frequent tokens.
PER_CLASS = 32
#: Tokens that one task counts, and pairs of one hub that one task verifies, on average.
COUNTED, VERIFIED = 1_000_000, 1024
#: Rounds that compare with hubs, rounds that compare with the nearest sets, and how many
#: of these a task names for a set, before the complete round.
HUB_ROUNDS, NEAREST_ROUNDS, NEAREST = 1, 1, 1
#: Bits of a sketch, sets of one entry that are compared with each other at a time.
SKETCH, BLOCK = 1024, 1024
#: Sets of a block whose pairs are named at a time, and pairs (of nearest ones: sets) that a
#: task remembers before it starts afresh: both bound the memory of a Python worker.
COMPARED, HELD = 64, 100_000
#: Tokens that a task collects before it passes them on.
COLLECTED = 1_000_000
#: Bytes of texts (one text at least) and words that a task hashes at a time, bytes of a word
#: that are hashed with those of all other words.
TOGETHER, AT_ONCE, SHORT = 1 << 19, 1 << 16, 64

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in texts that lie end to end, cut at the given places."""
    inside = (data != 32) & (data - np.uint8(9) >= 5)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # No word reaches across a cut.
    at = cuts[cuts < len(data)]
    begins[at] = inside[at]
    at = cuts[cuts > 0] - 1
    closes[at] = inside[at]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes of all words at a time; long words are hashed one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for part in range(0, len(starts), AT_ONCE):
        begin = starts[part : part + AT_ONCE]
        size = ends[part : part + AT_ONCE] - begin
        value = size.astype(np.uint64)
        some = np.arange(len(size))
        for done in range(0, SHORT, 8):
            some = some[size[some] > done]
            if not len(some):
                break
            bytes_ = eight[begin[some] + done] & masks[np.minimum(size[some] - done, 8)]
            value[some] = _mixed(value[some] * _MULTIPLY + bytes_)
        out[part : part + AT_ONCE] = value
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def _runs(marks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    runs = np.full(max(len(marks) - size + 1, 0), size, np.uint64)
    for i in range(size if len(runs) else 0):
        runs = _mixed(runs * _MULTIPLY + marks[i : len(marks) - size + 1 + i])
    return runs


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For every text sorted distinct hashes of the runs of ``k`` words (fewer words: of the whole).

    Texts are hashed together, as many as ``TOGETHER`` bytes hold; a word has the same hash everywhere.
    """
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, places, raw = column.buffers()
    places = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(places, places[start] + TOGETHER, "right")) - 1)
        cuts = places[start : end + 1] - places[start]
        data = whole[places[start] : places[end]]
        data = data + ((data - np.uint8(65) < 26).view(np.uint8) << 5)
        begins, closes = _words(data, cuts)
        marks = _marks(data, begins, closes)
        runs = _runs(marks, k)
        bounds = np.searchsorted(begins, cuts).tolist()
        for low, high in zip(bounds, bounds[1:]):
            if high - low >= k:
                tokens = runs[low : high - k + 1]
            else:
                tokens = _runs(marks[low:high], high - low)[: high - low]
            tokens.sort()
            fresh = tokens[1:] != tokens[:-1]
            yield tokens if fresh.all() else tokens[np.append(True, fresh)]
        start = end


def set_number(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_shared(n: int, percent: int) -> int:
    """Tokens that any linked set shares with a set of ``n``."""
    return -(-percent * n // 100)


def reduced_size(n: int, percent: int) -> int:
    return min(n, 2 * (n - least_shared(n, percent)) + 1)


def reduced_shared(n: int, percent: int) -> int:
    """Reduced tokens that a set of ``n`` shares with any linked set, whatever its size."""
    small = least_shared(n, percent)
    return small - least_shared(small, percent) + 1


def class_exponents(n: int, percent: int) -> range:
    """Powers of two of class numbers of a set of ``n``; -1: no classes, every token by itself.

    Classes need as many shared tokens and one more, so short sets have none.
    Linked sets have the power of the smaller one in common.
    """

    def power(size: int) -> int:
        return min(size // PER_CLASS, reduced_shared(size, percent) - 1).bit_length() - 1

    return range(power(least_shared(n, percent)), power(n) + 1)


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set of ``n``, from those of its reduced tokens that others have."""
    size, shared = reduced_size(n, percent), reduced_shared(n, percent)
    if len(tokens) < shared:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    alone = size - len(tokens)
    first = max(0, size - shared + 1 - alone)
    if first == 0 or counts[first - 1] <= RARE:
        # The rarest shared token lies in this prefix and is rare, so the other set has it by itself too.
        return np.sort(tokens[:first])
    out = []
    for power in class_exponents(n, percent):
        classes = 1 << power if power >= 0 else 0
        length = max(0, size - shared + 1 + classes - alone)
        prefix, often = tokens[:length], counts[:length] > RARE
        if not classes:
            out.append(prefix)
            continue
        out.append(prefix[~often])
        some = prefix[often]
        group = _mixed(some + np.uint64(1)) & np.uint64(classes - 1)
        by = np.argsort(group, kind="stable")
        some, group = some[by], group[by]
        for part in np.split(some, np.flatnonzero(group[1:] != group[:-1]) + 1):
            if len(part) > 1:
                part = np.sort(part)
                i, j = np.triu_indices(len(part), 1)
                out.append(_mixed(part[i] * _MULTIPLY + part[j] + np.uint64(power)))
    return np.unique(np.concatenate(out))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Fixed-width integers byte by byte, which compresses well when they are sorted."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1).T
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: ``data`` cut at the given places (0 and the end included)."""
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens of each of ``SKETCH`` classes."""
    which = (_mixed(tokens) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(which, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id); set_id is null for the empty set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, numbers = [], []
            for tokens in shingles(part.column(2), k):
                sizes.append(len(tokens))
                numbers.append(set_number(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64())],
                names=["doc_id", "text_hash", "n_shingles", "set_id"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, set_id long"
    )


def _reduced(docs: DataFrame, k: int, percent: int, ranges: int) -> DataFrame:
    """Reduced sets by range of the token: rows of many tokens and their owners."""
    names = ["range", "sets", "sizes", "owners", "tokens"]

    def passed_on(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([h[2] for h in held])
        owners = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        numbers = np.array([h[0] for h in held], np.int64)
        sizes = np.array([h[1] for h in held], np.int64)
        low = tokens & np.uint64(0xFFFFFFFF)
        place = (low * np.uint64(ranges)) >> np.uint64(32)
        order = np.lexsort((tokens, place))
        tokens, owners, place = tokens[order], owners[order], place[order]
        rows = []
        for part in np.split(np.arange(len(place)), np.flatnonzero(place[1:] != place[:-1]) + 1):
            own, index = np.unique(owners[part], return_inverse=True)
            rows.append(
                (
                    int(place[part[0]]), numbers[own].tobytes(), sizes[own].astype("<u4").tobytes(),
                    _planes(index, 4), _planes(tokens[part], 8),
                )
            )
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, waiting = set(), [], 0
        for part in parts:
            for tokens in shingles(part.column(0), k):
                number = set_number(tokens)
                # Copies within a task go on once; those of several tasks meet below.
                if not len(tokens) or number in seen:
                    continue
                seen.add(number)
                held.append((number, len(tokens), tokens[: reduced_size(len(tokens), percent)].copy()))
                waiting += len(held[-1][2])
                if waiting >= COLLECTED:
                    yield passed_on(held)
                    held, waiting = [], 0
        if held:
            yield passed_on(held)

    return docs.select("text").mapInArrow(
        run, "range int, sets binary, sizes binary, owners binary, tokens binary"
    )


def _shared(reduced: DataFrame) -> DataFrame:
    """(set_id, n, tokens, counts): tokens of a range that several sets have."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, sizes, tokens = [], [], []
        for own, size, index, token in held:
            index = _unplanes(index, 4).astype(np.int64)
            numbers.append(np.frombuffer(own, np.int64)[index])
            sizes.append(np.frombuffer(size, "<u4")[index])
            tokens.append(_unplanes(token, 8))
        number, size, token = (np.concatenate(x) for x in (numbers, sizes, tokens))
        order = np.lexsort((number, token))
        number, size, token = number[order], size[order], token[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
        number, size, token = number[fresh], size[fresh], token[fresh]
        _, index, count = np.unique(token, return_inverse=True, return_counts=True)
        often = count[index]
        keep = often > 1
        number, size, token, often = number[keep], size[keep], token[keep], often[keep]
        order = np.argsort(number, kind="stable")
        number, size, token, often = number[order], size[order], token[order], often[order]
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
        cuts = np.append(heads, len(number)).astype(np.int64)
        for start in range(0, len(heads), 20_000):
            part = cuts[start : start + 20_001]
            low, high = part[0], part[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number[part[:-1]]),
                    pa.array(size[part[:-1]].astype(np.int64)),
                    _blobs(token[low:high], part - low),
                    _blobs(often[low:high].astype("<u4"), part - low),
                ],
                names=["set_id", "n", "tokens", "counts"],
            )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in parts:
            for row in zip(*part.columns, strict=True):
                place, *data = (v.as_py() for v in row)
                if place != now and held:
                    yield from close(held)
                    held = []
                now = place
                held.append(tuple(data))
        if held:
            yield from close(held)

    return reduced.mapInArrow(run, "set_id long, n long, tokens binary, counts binary")


def _indexed(shared: DataFrame, percent: int) -> DataFrame:
    """(entry, set_id, n): the index, from rows of :func:`_shared` sorted by set."""

    def close(number: int, n: int, held: list[tuple]) -> np.ndarray:
        tokens = np.frombuffer(b"".join(t for t, _ in held), np.uint64)
        counts = np.frombuffer(b"".join(c for _, c in held), "<u4")
        return signatures(n, tokens, counts, percent)

    def batch(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(f[2]) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([f[2] for f in found]).view(np.int64)),
                pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
                pa.array(np.repeat(np.array([f[1] for f in found], np.int64), sizes)),
            ],
            names=["entry", "set_id", "n"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, waiting = None, [], [], 0
        for part in parts:
            lists = [part.column(i).to_pylist() for i in range(4)]
            for number, n, tokens, counts in zip(*lists):
                if now is not None and number != now[0]:
                    entries = close(*now, held)
                    if len(entries):
                        found.append((*now, entries))
                        waiting += len(entries)
                    held = []
                now = (number, n)
                held.append((tokens, counts))
                if waiting > 50_000:
                    yield batch(found)
                    found, waiting = [], 0
        if held:
            entries = close(*now, held)
            if len(entries):
                found.append((*now, entries))
        if found:
            yield batch(found)

    return shared.mapInArrow(run, "entry long, set_id long, n long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set_id, n, tokens, sketch) of the wanted sets, each from its representative document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for number, tokens in zip(part.column(0).to_pylist(), shingles(part.column(1), k), strict=True):
                # Another text under the same id is not the one meant.
                if len(tokens) and set_number(tokens) == number:
                    rows.append((number, len(tokens), _planes(tokens, 8), sketch(tokens)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                    names=["set_id", "n", "tokens", "sketch"],
                )

    joined = docs.select("doc_id", "text").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    found = joined.select("set_id", "text").mapInArrow(run, "set_id long, n long, tokens binary, sketch binary")
    return found.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "sketch")])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int, parts: int) -> DataFrame:
    """Those of the pairs (hub, other) that are linked."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / VERIFIED).cast("int").alias("salts"))
    salted = pairs.join(sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int"))
    whole = whole.drop("sketch")
    others = salted.select(F.col("other").alias("set_id"), "hub", "salt").join(whole, "set_id")
    hubs = sizes.select(
        F.col("hub").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    ).join(whole, "set_id")
    rows = others.select("hub", "salt", F.lit(1).alias("turn"), "set_id", "n", "tokens").unionByName(
        hubs.select(F.col("set_id").alias("hub"), "salt", F.lit(0).alias("turn"), "set_id", "n", "tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, size = None, np.zeros(0, np.uint64), 0
        for part in batches:
            found = []
            lists = [part.column(i).to_pylist() for i in range(5)]
            for hub, salt, turn, number, n, data in zip(*lists, part.column(5), strict=True):
                own = _unplanes(data.as_py(), 8)
                if turn == 0:
                    key, tokens, size = (hub, salt), own, n
                elif key == (hub, salt):
                    both = len(np.intersect1d(tokens, own, assume_unique=False))
                    if 100 * both >= percent * (size + n - both):
                        found.append((hub, number))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found)], names=["hub", "other"]
                )

    dealt = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "turn")
    return dealt.mapInArrow(run, "hub long, other long")


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that can be linked at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _hub_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """For every set the hub it meets most often, of another component."""
    pick = F.struct(F.xxhash64(F.lit(turn), "set_id").alias("by"), "set_id", "n", "component")
    hubs = entries.groupBy("entry").agg(F.min(pick).alias("pick")).select(
        "entry",
        F.col("pick.set_id").alias("hub"),
        F.col("pick.n").alias("hub_n"),
        F.col("pick.component").alias("hub_component"),
    )
    met = (
        entries.join(hubs, "entry")
        .filter(F.col("component") != F.col("hub_component"))
        .filter(_fits("n", "hub_n", percent))
        .groupBy(F.col("set_id").alias("other"), "hub")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    best = met.groupBy("other").agg(F.max(F.struct("times", "hub")).alias("best"))
    return best.select(F.col("best.hub").alias("hub"), "other")


def _may_link(n: np.ndarray, marks: np.ndarray, first: slice, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches let each set of the slice be linked with each set, and differing bits."""
    a, b = n[first, None], n[None, :]
    both = -(-percent * (a + b) // (100 + percent))
    fits = np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
    differing = np.zeros(fits.shape, np.int64)
    for word in range(marks.shape[1]):
        differing += np.bitwise_count(marks[first, word, None] ^ marks[None, :, word])
    return fits & (differing <= a + b - 2 * both), differing


def _left_pairs(entries: DataFrame, whole: DataFrame, percent: int, block: int, nearest: int = 0) -> DataFrame:
    """Pairs of sets of an entry that are in different components and may be linked.

    With ``nearest``, only so many for each set that a task meets, those with the
    most similar sketches.

    The sets of an entry are dealt to blocks of ``block`` sets, and each two blocks
    meet in a unit of work of their own; pairs do not leave the task that compares
    them unless their sketches allow a link.
    """
    mixed = (
        entries.groupBy("entry")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        .filter("low <> high")
        .select("entry", "blocks")
    )
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    units = (
        entries.join(mixed, "entry")
        .select("entry", "set_id", "component", own.alias("own"), each)
        .join(whole.select("set_id", "n", "sketch"), "set_id")
        .select("entry", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "set_id", "component", "n", "sketch")
    )

    def close(key: tuple, held: list[tuple]) -> Iterator[tuple[int, int, int]]:
        own, number, component, n, data = zip(*held)
        own, number, component, n = (np.array(x, np.int64) for x in (own, number, component, n))
        if (component == component[0]).all():
            return
        marks = np.frombuffer(b"".join(data), np.uint64).reshape(len(n), -1)
        for start in range(0, len(n), COMPARED):
            first = slice(start, start + COMPARED)
            hit, differing = _may_link(n, marks, first, percent)
            hit &= component[first, None] != component[None, :]
            if key[1] != key[2]:
                hit &= own[first, None] != own[None, :]
            if not nearest:
                hit &= component[first, None] < component[None, :]
            elif len(n) > nearest:
                differing = np.where(hit, differing, 1 << 40)
                last = np.partition(differing, nearest - 1, axis=1)[:, nearest - 1 : nearest]
                hit &= differing <= last
            at, to = np.nonzero(hit)
            yield from zip(number[start + at].tolist(), number[to].tolist(), differing[at, to].tolist())

    def pairs(found: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        known: set[tuple[int, int]] = set()
        best: dict[int, list[tuple[int, int]]] = {}
        for a, b, distance in found:
            if nearest:
                mine = best.setdefault(a, [])
                if (distance, b) not in mine:
                    mine.append((distance, b))
                    mine.sort()
                    del mine[nearest:]
                if len(best) < HELD:
                    continue
            elif (a, b) not in known:
                known.add((a, b))
                yield a, b
                if len(known) > HELD:
                    known.clear()
                continue
            yield from {(min(x, y), max(x, y)) for x, mine in best.items() for _, y in mine}
            best.clear()
        yield from {(min(x, y), max(x, y)) for x, mine in best.items() for _, y in mine}

    def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        now, held = None, []
        for part in parts:
            for entry, i, j, *row in zip(*[part.column(c).to_pylist() for c in range(8)], strict=True):
                if (entry, i, j) != now and held:
                    yield from close(now, held)
                    held = []
                now = (entry, i, j)
                held.append(tuple(row))
        if held:
            yield from close(now, held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(pairs(groups(parts)), pa.schema([("hub", pa.int64()), ("other", pa.int64())]), size=50_000)

    dealt = units.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    return dealt.mapInArrow(run, "hub long, other long").distinct()


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) per row; linked at ``percent`` of the union or more.

    ``component_id`` is the smallest doc_id reachable by links, the own one
    included. Null and empty texts have no shingles and link with nothing. Rows
    without an id take no part and have a null component. Rows that repeat an
    id each have their own set and its component. An empty table gives no rows;
    columns beside ``doc_id`` and ``text`` are not looked at.
    """
    spark = prepare(docs.sparkSession)
    rows = stored(sets(docs, k), "shingle-sets")
    classes = (
        rows.filter("doc_id is not null and set_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    )
    tokens = scalar(rows.agg(F.sum("n_shingles"))) or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, int(tokens * 2 * (100 - percent) / 100 // COUNTED) + 1)
    reduced = _reduced(docs.filter("doc_id is not null"), k, percent, ranges)
    shared = _shared(reduced.repartition(ranges, "range").sortWithinPartitions("range"))
    entries = _indexed(shared.repartition(ranges, "set_id").sortWithinPartitions("set_id"), percent)
    entries = stored(entries, "shingle-index")
    several = (
        entries.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("entry")
    )
    entries = stored(entries.join(several, "entry"), "shingle-entries")
    wanted = entries.select("set_id").distinct().join(classes.select("set_id", "rep"), "set_id")
    whole = stored(_whole_sets(docs, wanted, k), "shingle-whole")
    links, groups = None, None
    for turn in range(HUB_ROUNDS + NEAREST_ROUNDS + 1):
        if groups is None:
            now = entries.withColumn("component", F.col("set_id"))
        else:
            own = F.coalesce("component", "set_id").alias("component")
            now = entries.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select(
                "entry", "set_id", "n", own
            )
        if turn < HUB_ROUNDS:
            pairs = _hub_pairs(now, turn, percent)
        else:
            nearest = NEAREST if turn < HUB_ROUNDS + NEAREST_ROUNDS else 0
            pairs = _left_pairs(now, whole, percent, BLOCK, nearest)
        pairs = stored(pairs, f"shingle-pairs{turn}")
        found = stored(_verified(pairs, whole, percent, ranges), f"shingle-links{turn}")
        links = found if links is None else links.unionByName(found)
        groups = components(links, "hub", "other", f"shingle{turn}")
    named = classes.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "rep", F.coalesce("component", "set_id").alias("component")
    )
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "component").select(F.col("set_id").alias("s"), "component_id")
    joined = rows.join(final, F.col("set_id") == F.col("s"), "left")
    return joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of every group of linked ones, the one with the smallest id; columns unchanged.

    Documents without text or without an id stay. Of rows that repeat id and
    text one stays.
    """
    kept = (
        join(docs, k, percent)
        .filter("doc_id = component_id")
        .select(F.col("doc_id").alias("kept_doc"), F.col("text_hash").alias("kept_text"))
        .distinct()
    )
    named = docs.filter("doc_id is not null").select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("kept_doc"), F.xxhash64("text").alias("kept_text")
    )
    chosen = named.join(kept, ["kept_doc", "kept_text"], "left_semi").dropDuplicates(["kept_doc", "kept_text"])
    return chosen.select("row.*").unionByName(docs.filter("doc_id is null"))
