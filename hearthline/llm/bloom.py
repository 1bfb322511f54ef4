"""Blocked Bloom filters of 64-bit hashes, built by Spark and used within tasks.

A block has 512 bits, of which a hash sets four. Filters are only ever used to
leave rows out of a shuffle whose join decides exactly: what they let through
wrongly costs work, never a result. All filters together have ``MAX_BLOCKS``
blocks (and one per shard) at most, whatever the number of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per hash, and blocks of 64 bytes of all filters together (32 MB).
BITS, MAX_BLOCKS = 16, 1 << 19

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and four bits within it as one row per hash."""
    block = (((hashes * _A) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    y = (hashes ^ (hashes >> np.uint64(32))) * _B
    bits = np.stack([(y >> np.uint64(9 * i + 20)) & np.uint64(511) for i in range(4)], axis=1)
    return block.astype(np.int64), bits.astype(np.int64)


def held(shard: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; a filter that does not exist holds none."""
    if shard is None:
        return np.zeros(len(hashes), bool)
    block, bits = places(hashes, len(shard))
    out = np.ones(len(hashes), bool)
    for i in range(4):
        out &= (shard[block, bits[:, i] >> 3] >> (bits[:, i] & 7).astype(np.uint8)) & 1 != 0
    return out


def _bit(i: int, word: int) -> Column:
    """What bit ``i`` of a hash sets in one of the eight 64-bit words of its block."""
    bit = F.col(f"b{i}")
    return F.when(F.floor(bit / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(
        F.lit(0).cast("long")
    )


def build(hashes: DataFrame) -> dict[int, np.ndarray]:
    """Filters by shard, as rows of 64 bytes, from a frame of (shard int, hash long).

    Bits are united by block before and after the shuffle; only finished blocks
    reach the driver.
    """
    sizes = {r["shard"]: r["n"] for r in hashes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = min(1.0, MAX_BLOCKS * 512 / (BITS * max(1, sum(sizes.values()))))
    blocks = {shard: int(n * BITS * scale / 512) + 1 for shard, n in sizes.items()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shards, values = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
            for shard in np.unique(shards).tolist():
                block, bits = places(values[shards == shard], blocks[shard])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(block), shard, np.int32)),
                        pa.array(block),
                        *(pa.array(bits[:, i].astype(np.int32)) for i in range(4)),
                    ],
                    names=["shard", "block", "b0", "b1", "b2", "b3"],
                )

    bits = hashes.mapInArrow(run, "shard int, block long, b0 int, b1 int, b2 int, b3 int")
    words = [
        F.bit_or(_bit(0, w).bitwiseOR(_bit(1, w)).bitwiseOR(_bit(2, w)).bitwiseOR(_bit(3, w))).alias(f"w{w}")
        for w in range(8)
    ]
    filled = bits.groupBy("shard", "block").agg(*words).toArrow()
    out = {shard: np.zeros((n, 64), np.uint8) for shard, n in blocks.items()}
    shards, at = filled.column("shard").to_numpy(), filled.column("block").to_numpy()
    rows = np.stack([filled.column(f"w{w}").to_numpy() for w in range(8)], axis=1).astype("<i8").view(np.uint8)
    for shard in out:
        own = shards == shard
        out[shard][at[own]] = rows[own]
    return out
