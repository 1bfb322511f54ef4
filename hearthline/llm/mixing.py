"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, the
source's target over its size. The whole part is certain; the fractional parts
are settled pairwise: of two documents, words are moved from one to the other,
in a random direction that keeps both expectations, until one of the two
fractions is 0 or 1. The words of a pair never change, so the taken words of a
source differ from its target by less than the one document that is left over
at the root. It goes to its nearer whole number, and the one settled document
whose change of mind comes nearest to the words then missing makes up for them.

The pairs form a reduction tree: documents meet in small random blocks, the one
open document of each block goes on to the next level, until a source has one
block. A source with a third of all rows is simply a source with more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import WORD, prepare, scalar, stored

#: Documents that meet in one block of the tree, on average.
BLOCK = 256
UNIT = ("doc_id", "text_hash", "mass", "p", "key")


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], ratio: float, cap: float) -> DataFrame:
    """Target words per source, from rows of (source, source_size).

    Sources in code point order (null last) take the weights in turn and share
    ``ratio`` of all words by weight; none gets more than ``cap`` times its
    size. With t = min(cap * size, level * weight), the sources that reach
    their cap are those with the smallest cap-to-weight ratio, so the common
    level follows from running sums in that order.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn(
        "weight", F.element_at(cycle, (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    share = F.least(
        F.sum("source_size").over(everything) * F.lit(float(ratio)), F.sum("most").over(everything)
    )
    left = share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    level = left / weight_left
    # Beyond the first source that stays below its cap the candidates only fall.
    uncapped = F.max(
        F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))
    ).over(everything)
    return (
        weighted.withColumn("level", level)
        .withColumn("level", uncapped)
        .select(
            "source",
            "source_size",
            F.when(
                F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("most")),
                F.col("most"),
            )
            .otherwise(F.col("level") * F.col("weight"))
            .alias("target"),
        )
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use).getItem(0)


def _with_p(unit: Column, p: Column) -> Column:
    return F.struct(*[p.alias("p") if c == "p" else unit[c].alias(c) for c in UNIT])


def _uniform(seed: int, a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(state: Column, unit: Column, seed: int) -> Column:
    """One pair: the block's open document and the next one."""
    held = state["open"]

    def moved(x: Column) -> Column:
        up = x["u"] * (x["gain"] + x["loss"]) < x["loss"]
        first = F.when(
            up,
            F.when(x["gain"] >= x["room"], 1.0).otherwise(held["p"] + x["gain"] / held["mass"]),
        ).otherwise(
            F.when(x["loss"] >= x["has"], 0.0).otherwise(held["p"] - x["loss"] / held["mass"])
        )
        second = F.when(
            up,
            F.when(x["gain"] >= x["its_has"], 0.0).otherwise(unit["p"] - x["gain"] / unit["mass"]),
        ).otherwise(
            F.when(x["loss"] >= x["its_room"], 1.0).otherwise(unit["p"] + x["loss"] / unit["mass"])
        )
        return F.array(_with_p(held, first), _with_p(unit, second))

    room, has = (1 - held["p"]) * held["mass"], held["p"] * held["mass"]
    its_room, its_has = (1 - unit["p"]) * unit["mass"], unit["p"] * unit["mass"]
    masses = F.struct(
        room.alias("room"),
        has.alias("has"),
        its_room.alias("its_room"),
        its_has.alias("its_has"),
        F.least(room, its_has).alias("gain"),
        F.least(has, its_room).alias("loss"),
        _uniform(seed, held["key"], unit["key"]).alias("u"),
    )
    whole = lambda x: (x["p"] <= 0.0) | (x["p"] >= 1.0)
    pair = _bound(masses, moved)
    met = _bound(
        pair,
        lambda two: F.struct(
            F.get(F.filter(two, lambda x: ~whole(x)), F.lit(0)).alias("open"),
            F.concat(state["done"], F.filter(two, whole)).alias("done"),
        ),
    )
    return F.when(held.isNull(), F.struct(unit.alias("open"), state["done"].alias("done"))).otherwise(
        met
    )


def _settle(units: DataFrame, seed: int) -> DataFrame:
    """Fold each block; rows come back settled (p 0 or 1), one per block maybe still open."""
    kind = (
        "struct<doc_id:" + dict(units.dtypes)["doc_id"] + ",text_hash:bigint,mass:double,"
        "p:double,key:bigint>"
    )
    unit = F.struct(*UNIT)
    # Large documents first: the many small ones then absorb what they leave open.
    ordered = F.array_sort(
        F.collect_list(unit),
        lambda a, b: F.when(a["mass"] != b["mass"], F.when(a["mass"] > b["mass"], -1).otherwise(1))
        .when(a["key"] != b["key"], F.when(a["key"] < b["key"], -1).otherwise(1))
        .otherwise(0),
    )
    start = F.struct(
        F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done")
    )
    folded = units.groupBy("source", "block").agg(ordered.alias("units"))
    folded = folded.select(
        "source",
        F.aggregate("units", start, lambda s, u: _meet(s, u, seed)).alias("end"),
    )
    rows = F.concat(
        F.col("end.done"),
        F.filter(F.array(F.col("end.open")), lambda x: x.isNotNull()),
    )
    return folded.select("source", F.explode(rows).alias("unit")).select("source", "unit.*")


def _repaired(settled: DataFrame) -> DataFrame:
    """Round the open document of each root; let one settled document make up for it."""
    nearer = F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("long")
    rounded = settled.withColumn("extra", nearer)
    gaps = (
        rounded.filter((F.col("p") > 0) & (F.col("p") < 1))
        .groupBy(F.col("source").alias("gap_source"))
        .agg(F.sum((F.col("p") - F.col("extra")) * F.col("mass")).alias("gap"))
    )
    met = rounded.join(gaps, F.col("source").eqNullSafe(F.col("gap_source")))
    helps = F.when(F.col("gap") > 0, F.col("extra") == 0).otherwise(F.col("extra") == 1)
    miss = F.abs(F.abs("gap") - F.col("mass"))
    swap = (
        met.filter(helps & (miss < F.abs("gap")))
        .groupBy("gap_source")
        .agg(F.min(F.struct(miss.alias("miss"), "key")).alias("best"))
        .select("gap_source", F.col("best.key").alias("swap"))
    )
    return (
        rounded.join(
            swap,
            F.col("source").eqNullSafe(F.col("gap_source")) & (F.col("key") == F.col("swap")),
            "left",
        )
        .withColumn("extra", F.when(F.col("swap").isNull(), F.col("extra")).otherwise(1 - F.col("extra")))
        .drop("gap_source", "swap")
    )


def copies(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """Number of copies of every document in the mix.

    Rows of (source, doc_id, text_hash, size, source_size, target, copies), one
    per distinct (source, doc_id, text): rows that agree in these are one
    document and taken together. Null sources are a source of their own, sorted
    last; null ids and texts are values like any other. Documents without words
    have size 0 and get the whole part of their source's rate; a source without
    words has target 0 and no copies. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    counted = stored(
        docs.select(
            "source",
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            words(F.col("text")).alias("size"),
        )
        .groupBy("source", "doc_id", "text_hash", "size")
        .agg(F.count(F.lit(1)).alias("rows")),
        "mix-units",
    )
    totals = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    aims = targets(totals.select("source", "source_size"), weights, ratio, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = (
        aims.withColumnRenamed("source", "s")
        .join(totals.select(F.col("source").alias("t"), "n"), F.col("s").eqNullSafe(F.col("t")))
        .drop("t")
    )
    units = (
        counted.join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("p", rate - F.floor(rate))
        .withColumn("mass", (F.col("size") * F.col("rows")).cast("double"))
        .withColumn("key", F.xxhash64("source", "doc_id", "text_hash"))
    )
    open_units = stored(
        units.filter((F.col("mass") > 0) & (F.col("p") > 0)).select("source", "n", *UNIT), "mix-open"
    )
    settled, level = None, 0
    blocks = scalar(open_units.agg(F.max(F.ceil(F.col("n") / BLOCK)))) or 0
    while blocks:
        # Spread the open documents of each source over a BLOCK-th as many blocks.
        share = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(BLOCK) ** (level + 1))))
        spread = open_units.withColumn(
            "block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), share)
        )
        sizes = open_units.select(F.col("source").alias("s"), "n").distinct()
        done = _settle(spread, seed + level)
        done = stored(
            done.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s"), f"mix-level{level}"
        )
        ends = done if blocks == 1 else done.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        settled = ends if settled is None else settled.unionByName(ends)
        if blocks == 1:
            break
        open_units = done.filter((F.col("p") > 0) & (F.col("p") < 1))
        blocks, level = -(-blocks // BLOCK), level + 1
    result = units
    if settled is not None:
        extra = _repaired(settled).select(
            F.col("source").alias("s"),
            F.col("doc_id").alias("d"),
            F.col("text_hash").alias("h"),
            F.col("extra"),
        )
        result = units.join(
            extra,
            F.col("source").eqNullSafe(F.col("s"))
            & F.col("doc_id").eqNullSafe(F.col("d"))
            & (F.col("text_hash") == F.col("h")),
            "left",
        )
    else:
        result = units.withColumn("extra", F.lit(0).cast("long"))
    return result.select(
        "source",
        "doc_id",
        "text_hash",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"),
        "rows",
    )


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it is taken, all columns kept."""
    found = copies(docs, **options).select(
        F.col("source").alias("mix_source"),
        F.col("doc_id").alias("mix_doc"),
        F.col("text_hash").alias("mix_hash"),
        F.col("copies").alias("mix_copies"),
    )
    joined = docs.join(
        found.filter(F.col("mix_copies") > 0),
        F.col("source").eqNullSafe(F.col("mix_source"))
        & F.col("doc_id").eqNullSafe(F.col("mix_doc"))
        & (F.xxhash64("text") == F.col("mix_hash")),
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return joined.select(*[docs[c] for c in docs.columns], again.alias("mix_copy")).drop("mix_copy")


def taken(docs: DataFrame, **options: object) -> DataFrame:
    """Digest per row of ``docs``: its size, its source's size and target, the words taken."""
    found = copies(docs, **options)
    # Equal rows are one unit above; here every one of them is a row again.
    return found.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("repeat"),
    ).drop("repeat")
