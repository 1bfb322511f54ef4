"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; the axis it then lies nearest to, with its sign, is its hash. A table
joins several such hashes to one bucket. A vector enters its own bucket and, per
table, the ones it would have fallen in with the smallest change (multiprobe).
Pairs in a bucket are candidates; each is verified with its exact cosine.

Equal vectors are collapsed before and counted in again afterwards. A bucket
larger than ``BLOCK`` is cut into blocks, and every pair of blocks is a task of
its own. A pair that meets in several buckets counts in the first of them only,
which both members can tell from their bucket lists. Blocks send back link
counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import prepare, scalar, stored, unit_rows
from hearthline.llm.components import components

THRESHOLD = 0.95
#: Tables while a table joins up to three hashes; with more of them a pair is met more
#: rarely in each table, and ``GROWTH`` times as many tables a hash keep recall level.
TABLES, GROWTH = 8, 1.7
#: Neighbouring buckets that are tried besides the own one, per table.
PROBES = 2
#: Vectors of one block of a bucket, on average.
BLOCK = 1024
#: Vectors that share a bucket by chance, on average; sets how many hashes a table joins.
CHANCE = 8
#: Groups up to this size are looked through for links together.
SMALL = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def table_count(hashes: int) -> int:
    """Tables needed for a recall of 0.999 at the threshold (measured in 64 dimensions)."""
    return math.ceil(TABLES * GROWTH ** max(0, hashes - 3))


def buckets(vectors: np.ndarray, hashes: int, tables: int, probes: int, seed: int = 5) -> np.ndarray:
    """Bucket numbers: rows by (tables, 1 + probes); the first of each table is the own one."""
    n, dims = vectors.shape
    size = max(2, 1 << (dims - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dims] = vectors
    random = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * random.choice([-1.0, 1.0], size))
            strength = np.abs(x)
            top = np.argpartition(-strength, 1, axis=1)[:, :2] if size > 2 else np.argsort(-strength, axis=1)
            value = np.take_along_axis(strength, top, axis=1)
            swap = value[:, 0] < value[:, 1]
            top[swap], value[swap] = top[swap][:, ::-1], value[swap][:, ::-1]
            sign = np.take_along_axis(x, top, axis=1) < 0
            code = top + size * sign
            best.append(code[:, 0])
            second.append(code[:, 1])
            loss.append(value[:, 0] - value[:, 1])
        base = np.stack(best, axis=1)
        other, cost = np.stack(second, axis=1), np.stack(loss, axis=1)
        order = np.argsort(cost, axis=1)
        for p in range(1 + probes):
            codes = base.copy()
            if p:
                # The p-th probe takes the second-nearest axis in the hash where that costs least.
                which = order[:, (p - 1) % hashes]
                rows = np.arange(n)
                codes[rows, which] = other[rows, which]
            number = np.full(n, t, np.int64)
            for h in range(hashes):
                number = number * (2 * size + 1) + codes[:, h] + 1
            out[:, t, p] = number
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """Distinct usable vectors with their smallest id and number of rows.

    Left out are null, empty and zero vectors, those with null or non-finite
    components, and rows without an id.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(x, lambda c: c != 0)
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(~bad & some)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    )


def _signed(distinct: DataFrame, dims: int, hashes: int) -> DataFrame:
    """One row per distinct vector: (rep, rows, embedding, all its buckets)."""
    tables = table_count(hashes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column(0), dims)
            found = buckets(x, hashes, tables, PROBES)
            n, per = len(x), tables * (1 + PROBES)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1),
                    part.column(2),
                    part.column(0),
                    pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(n * per)), per).cast(
                        pa.list_(pa.int64())
                    ),
                ],
                names=["rep", "rows", "embedding", "buckets"],
            )

    kind = distinct.schema["embedding"].dataType.simpleString()
    return distinct.select("embedding", "rep", "rows").mapInArrow(
        run, f"rep long, rows long, embedding {kind}, buckets array<long>"
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as unit rows in double precision; missing trailing components are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), int)
    out = np.zeros((len(lengths), dims))
    keep = np.arange(dims) < lengths[:, None]
    out[keep] = flat
    # Scaled first, so that squares of very large or small components stay finite.
    most = np.abs(out).max(axis=1, keepdims=True)
    return unit_rows(np.divide(out, most, out=np.zeros_like(out), where=most > 0))


LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(
    bucket: int, reps: np.ndarray, rows: np.ndarray, x: np.ndarray, lists: np.ndarray,
    side: np.ndarray,
) -> list[np.ndarray]:
    """Verified links within a block (side 0 only) or between two (sides 1 and 2)."""
    if (side == 0).all():
        near = np.triu(x @ x.T >= THRESHOLD, 1)
        left = right = np.arange(len(reps))
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        near = x[left] @ x[right].T >= THRESHOLD
    i, j = np.nonzero(near)
    if not len(i):
        return []
    i, j = left[i], right[j]
    links = np.zeros(len(reps), np.int64)
    for start in range(0, len(i), 1 << 16):
        a, b = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
        # The buckets both are in; the smallest of them is where the pair counts.
        la, lb = lists[a], lists[b]
        first = np.full(len(a), np.iinfo(np.int64).max)
        for k in range(la.shape[1]):
            met = (lb == la[:, k : k + 1]).any(axis=1)
            first = np.where(met, np.minimum(first, la[:, k]), first)
        here = first == bucket
        np.add.at(links, a[here], rows[b[here]])
        np.add.at(links, b[here], rows[a[here]])
    root = _forest(len(reps), i, j)
    linked = np.unique(np.concatenate([i, j]))
    return [reps[linked], links[linked], reps[root[linked]]]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A representative index per node such that linked nodes share it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _links(blocks: DataFrame, dims: int) -> DataFrame:
    """Runs over rows sorted by (bucket, block_a, block_b), one group at a time."""
    keys = ("bucket", "block_a", "block_b")

    def arrays(part: pa.RecordBatch) -> list[np.ndarray]:
        lists = part.column("buckets")
        return [
            np.stack([part.column(c).to_numpy().astype(np.int64) for c in keys], axis=1),
            part.column("rep").to_numpy(),
            part.column("rows").to_numpy(),
            _matrix(part.column("embedding"), dims),
            lists.flatten().to_numpy().reshape(len(lists), -1),
            part.column("side").to_numpy(),
        ]

    def solve(data: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[list[np.ndarray]]:
        """Results of the groups that hold links; most chance groups are told at once."""
        group = np.repeat(np.arange(len(starts)), ends - starts)
        x = data[3][: len(group)]
        near = ends - starts > SMALL
        for shift in range(1, min(SMALL, len(group))):
            pair = (group[shift:] == group[:-shift]) & (
                np.einsum("ij,ij->i", x[shift:], x[:-shift]) >= THRESHOLD
            )
            near[group[:-shift][pair]] = True
        out = []
        for k in np.flatnonzero(near):
            own = slice(starts[k], ends[k])
            found = _verify(int(data[0][starts[k], 0]), *[d[own] for d in data[1:]])
            if found:
                out.append(found)
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []  # rows of the group that the last batch ended in
        for part in parts:
            if not part.num_rows:
                continue
            data = arrays(part)
            if waiting and (waiting[-1][0][-1] == data[0][0]).all() and (data[0][0] == data[0][-1]).all():
                waiting.append(data)
                continue
            data = [np.concatenate(d) for d in zip(*waiting, data)]
            cuts = np.flatnonzero((data[0][1:] != data[0][:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], cuts])
            out = solve(data, starts[:-1], starts[1:])
            waiting = [[d[starts[-1] :] for d in data]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=LINKS)
        if waiting:
            data = [np.concatenate(d) for d in zip(*waiting)]
            out = solve(data, np.array([0]), np.array([len(data[1])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[0]], schema=LINKS)

    return blocks.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows with cosine of at least ``THRESHOLD``,
    ``component_id`` is the smallest id reachable by links. Rows with an
    unusable vector (see :func:`usable`) link with nothing and are their own
    component. A missing id stays null and is never kept. Rows that repeat an
    id and a vector link with each other. Shorter vectors are compared as if
    zeros followed. Other columns are not looked at.
    """
    spark = prepare(embeddings.sparkSession)
    vectors = embeddings.select("vec_id", "embedding")
    distinct = stored(usable(vectors), "vectors")
    n, dims = distinct.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    result = vectors.select("vec_id", "embedding")
    if not n:
        return result.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    cells = 2 * (1 << max(1, (dims - 1).bit_length()))
    hashes = 1
    while cells**hashes * CHANCE < n * (1 + PROBES) and cells ** (hashes + 1) < 1 << 55:
        hashes += 1
    signed = _signed(distinct, dims, hashes)
    entries = signed.select("*", F.explode(F.array_distinct("buckets")).alias("bucket"))
    # Buckets with more vectors than a block are cut; the list of these is short.
    large = stored(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK),
        "vector-buckets",
    )
    cut = entries.join(large, "bucket", "left").withColumn(
        "parts", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
    )
    block = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    placed = cut.withColumn("block", block).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    dealt = placed.select(
        "bucket", low.alias("block_a"), high.alias("block_b"), side.alias("side"), "rep", "rows",
        "embedding", "buckets",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * table_count(hashes) * (1 + PROBES) // 200_000)
    dealt = dealt.repartition(parts, "bucket", "block_a", "block_b").sortWithinPartitions(
        "bucket", "block_a", "block_b"
    )
    found = stored(
        _links(dealt, dims).groupBy("rep", "root").agg(F.sum("links").alias("links")), "vector-links"
    )
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "root", "vectors")
    per_vector = (
        distinct.join(linked, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).cast("long").alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    usable_id = F.col("vec_id").isNotNull()
    joined = result.join(per_vector, (F.col("embedding") == F.col("e")) & usable_id, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
