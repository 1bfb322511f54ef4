"""Connected components of a graph that is given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import scalar, stored


def components(edges: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that it reaches.

    Alternates two steps until no edge changes: every node links its larger
    neighbours to its smallest one, then its smaller ones. Each round only
    groups and joins by node, so a node with very many edges is pre-aggregated
    before it is shuffled, and the number of rounds grows with the logarithm of
    the longest chain. Rounds are written to the shared folder; one number per
    round comes to the driver. Edges with a null end and loops are left out.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    now = stored(
        ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{label}-edges",
    )
    if not scalar(now.agg(F.count(F.lit(1)))):
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    turn, mark = 0, None
    while True:
        after = stored(_small(_large(now)), f"{label}-round{turn}")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        now, mark, turn = after, tuple(state), turn + 1
    # Every edge now leads from a node to the smallest of its component.
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.filter("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    lower = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return lower.unionByName(own).filter("u <> v").distinct()
