"""Exact top-k by inner product as a Voronoi nearest-neighbour join.

With one more coordinate, largest inner product is nearest neighbour: data
vectors x become (x, sqrt(M^2 - |x|^2)), M the largest length, queries (q, 0);
then the squared distance is |q|^2 + M^2 - 2 q.x.

Pivots cut the space into cells, and the radius cuts large cells into bands.
Queries and data go to the cell of their nearest pivot. Summaries of the cells
(largest radius of the queries, the k + 1 smallest radii of the data, extremes
and sizes of the bands) bound how far the k-th neighbour of any query of a cell
can be; only data whose distance to its own pivot is compatible with this bound
is sent to the queries of that cell. What reaches a cell is dealt into bins;
blocks of its queries are copied to these bins and to no others, so that bounded
groups meet in a task, and their best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import prepare, stored

SCALE = 256
#: Queries and data rows that meet in one task, on average.
QUERY_BLOCK, DATA_CHUNK = 512, 16384
#: Pivots: one for QUERY_BLOCK queries, within these limits. Data is sent once per block
#: of queries in any case, so more pivots cost nothing while their cells fill a block.
#: The routes, at most BANDS times MAX_PIVOTS squared rows, pass the driver.
MIN_PIVOTS, MAX_PIVOTS, BANDS = 16, 256, 8
EXACT = float(1 << 53)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) as doubles; missing trailing components are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), int)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = np.floor(SCALE * flat)
    return out


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles, in Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    return to_int(queries) @ to_int(data).T


def usable(embeddings: DataFrame) -> DataFrame:
    """One row per id; without null vectors, null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )


def _placed(data: DataFrame, pivots: np.ndarray, dims: int, longest: float) -> DataFrame:
    """Data with its nearest pivot and distance, and the same as seen as a query."""
    shared = data.sparkSession.sparkContext.broadcast(pivots)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = shared.value
        d = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)
        cell = d.argmin(axis=1)
        return cell, np.sqrt(np.maximum(d[np.arange(len(x)), cell], 0))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = whole(part.column(1), dims)
            last = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
            cell, radius = nearest(np.column_stack([x, last]))
            query_cell, query_radius = nearest(np.column_stack([x, np.zeros(len(x))]))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    *[pa.array(v) for v in (cell.astype(np.int32), radius, query_cell.astype(np.int32), query_radius)],
                ],
                names=["vec_id", "embedding", "cell", "radius", "query_cell", "query_radius"],
            )

    kind = data.schema["embedding"].dataType.simpleString()
    return data.select("vec_id", "embedding").mapInArrow(
        run,
        f"vec_id long, embedding {kind}, cell int, radius double, query_cell int, query_radius double",
    )


def _norms(data: DataFrame) -> Column:
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))).cast("double"))
    return F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)


def _bands(placed: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Edges of the bands per cell, and (cell, band, rows, smallest, largest radius) of every band.

    Cells of up to DATA_CHUNK rows are one band, others as many as chunks, BANDS at most.
    """
    steps = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("radius", steps, F.lit(1000)).alias("edges")
    )
    edges = F.when(F.col("n") > DATA_CHUNK, F.array_distinct("edges")).otherwise(F.lit([]).cast("array<double>"))
    found = cells.select("cell", edges.alias("edges")).collect()
    table = placed.sparkSession.createDataFrame(found, "cell int, edges array<double>")
    summary = (
        banded(placed, table)
        .groupBy("cell", "band")
        .agg(F.count(F.lit(1)), F.min("radius"), F.max("radius"))
        .orderBy("cell", "band")
    )
    return table, [tuple(r) for r in summary.collect()]


def banded(placed: DataFrame, edges: DataFrame) -> DataFrame:
    below = F.filter("edges", lambda e: e < F.col("radius"))
    return placed.join(F.broadcast(edges), "cell").withColumn("band", F.size(below)).drop("edges")


def _bounds(placed: DataFrame, queries: DataFrame, apart: np.ndarray, k: int) -> list[tuple]:
    """(query cell, largest radius of its queries, bound of their k-th distance, query blocks)."""
    order = Window.partitionBy("cell").orderBy("radius", "vec_id")
    near = (
        placed.select("cell", "radius", "vec_id")
        .withColumn("turn", F.row_number().over(order))
        .filter(F.col("turn") <= k + 1)
        .select("cell", "radius")
        .collect()
    )
    asked = queries.groupBy("query_cell").agg(F.max("query_radius"), F.count(F.lit(1))).collect()
    cells, radii = np.array([r["cell"] for r in near], int), np.array([r["radius"] for r in near])
    rows = []
    for cell, radius, n in asked:
        # Upper bounds of the distance to known data; one of these may be the query itself.
        upper = np.sort(radius + apart[cell, cells] + radii)
        rows.append((cell, radius, upper[k] if len(upper) > k else np.inf, -(-n // QUERY_BLOCK)))
    return rows


def routes(bounds: list[tuple], bands: list[tuple], apart: np.ndarray, slack: float) -> list[tuple]:
    """(cell, band, to_cell, low, high, blocks, first bin, bins dealt to) of all bands that a cell needs.

    Small bands share a bin up to DATA_CHUNK rows; larger ones get bins of their own.
    """
    out = []
    for to_cell, radius, bound, blocks in bounds:
        bin_, held = 0, 0
        for cell, band, n, least, most in bands:
            low = apart[to_cell, cell] - radius - bound - slack
            high = apart[to_cell, cell] + radius + bound + slack
            if most < low or least > high:
                continue
            own = -(-n // DATA_CHUNK)
            if held and held + n > DATA_CHUNK:
                bin_, held = bin_ + 1, 0
            out.append((cell, band, to_cell, float(low), float(high), blocks, bin_, own))
            held += n
            if own > 1:
                bin_, held = bin_ + own, 0
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(row, column) of the k best of each row, ties to the smaller id; columns sorted by id."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return zip(row[place < k], column[place < k])


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` largest integer inner products per query: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` holds, candidates all rows but
    the query's own; fewer candidates give fewer ranks. Rows that repeat an id
    are one vector (the smallest); shorter vectors count as followed by zeros;
    unusable vectors and rows without an id take no part. Scores must fit a
    long; they are exact at any size. Without queries or data the result is empty.
    """
    spark = prepare(embeddings.sparkSession)
    data = stored(usable(embeddings.select("vec_id", "embedding")), "topk-data")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dims, longest = data.agg(
        F.count(F.lit(1)), F.max(F.size("embedding")), F.max(_norms(data))
    ).first()
    if not n or not dims:
        return empty
    longest = float(longest)
    asked = data.filter(is_query).count()
    count = min(max(-(-asked // QUERY_BLOCK), MIN_PIVOTS), MAX_PIVOTS)
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("embedding").collect()
    lists = pa.array([r["embedding"] for r in chosen], pa.list_(pa.float64()))
    p = whole(lists, dims)
    pivots = np.column_stack([p, np.sqrt(np.maximum(longest - (p * p).sum(1), 0))])
    squares = (pivots * pivots).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * (pivots @ pivots.T), 0))
    # Rounding of squared distances, which are differences of squares up to the largest length.
    slack = 8 * float(np.sqrt((dims + 1) * np.finfo(float).eps)) * (1 + longest**0.5)
    placed = stored(_placed(data, pivots, dims, longest), "topk-cells")
    queries = placed.filter(is_query)
    edges, bands = _bands(placed)
    ways = routes(_bounds(placed, queries, apart, k), bands, apart, slack)
    if not ways:
        return empty
    way_table = spark.createDataFrame(
        ways, "cell int, band int, to_cell int, low double, high double, blocks int, first int, own int"
    )
    spread = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("own")).cast("int")
    sent = (
        banded(placed, edges)
        .join(F.broadcast(way_table), ["cell", "band"])
        .filter(F.col("radius").between(F.col("low"), F.col("high")))
        .select(
            "to_cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            (F.col("first") + spread).alias("bin"), F.col("vec_id").alias("vec_id"),
            F.col("embedding").alias("known"),
        )
    )
    reached = way_table.groupBy(F.col("to_cell").alias("query_cell"), "blocks").agg(
        F.max(F.col("first") + F.col("own") - 1).alias("last")
    )
    asking = queries.join(F.broadcast(reached), "query_cell").select(
        F.col("query_cell").alias("to_cell"),
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"),
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("asked"),
    )

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            ids = right.column("vec_id").to_numpy()
            asked = left.column("query_id").to_numpy()
            scores = products(
                whole(left.column("asked").combine_chunks(), dims),
                whole(right.column("known").combine_chunks(), dims),
            )
            own = asked[:, None] == ids[None, :]
            if own.any():
                # The own row is the worst there can be, and taken out afterwards.
                scores[own] = min(int(scores.min()), 0) - 1
            for i, j in _best(scores, ids, k + 1):
                if not own[i, j]:
                    out.append((int(asked[i]), int(ids[j]), int(scores[i, j])))
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
        )

    key = ["to_cell", "block", "bin"]
    local = (
        asking.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
