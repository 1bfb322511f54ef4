"""Exact, linearly interpolated quantiles with bounded work per task.

The built-in ``percentile`` merges all distinct values of a group in one task.
Here equal values are first collapsed into counts (map-side), a histogram of those
counts tells in which cells the wanted ranks fall, and only the values of these
cells are ranked. Cells are ``FINE`` times narrower than the width a caller asks
for: the histogram stays report-sized (its rows are bounded by the range of the
values, not by their number), and however many distinct values a group has, one
task ranks a hundred-thousandth of them or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.columns import same

RANK = ("i", "low", "high", "weight")
#: Parts of a kept cell.
SPLIT = 1024
#: Cells of the histogram per width.
FINE = 64


def cell_of(value: Column, width: float) -> Column:
    """Histogram cell of a value."""
    return F.floor(value / width)


def offset(value: Column, cell: Column, width: float) -> Column:
    """Distance of a value from the lower edge of its cell.

    Moments are summed over these small offsets, which loses far fewer digits
    than summing squares of the values.
    """
    return value - cell * width


def part_of(value: Column, cell: Column, width: float) -> Column:
    """Part of its cell that a value lies in; rounding at the edges makes no parts outside the cell."""
    inner = F.floor(offset(value, cell, width) * (SPLIT / width))
    return F.greatest(F.lit(0), F.least(inner, F.lit(SPLIT - 1)))


def histogram_totals(
    cells: DataFrame, groups: list[str], width: float, extras: tuple[str, ...] = ()
) -> DataFrame:
    """Add group totals and the number of rows in earlier cells to a histogram.

    ``cells`` has ``cell``, ``m`` (rows), ``s`` and ``ss`` (sums of offsets and of
    their squares); a null cell holds rows without a value. Adds ``before``,
    ``n_rows``, ``n``, ``mean``, ``square`` (squared deviations) and the sums of
    ``extras``. Only histogram rows pass through the window, and all totals share
    one.
    """
    span = Window.partitionBy(*groups).orderBy(F.col("cell").asc_nulls_last())
    whole = span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = span.rowsBetween(Window.unboundedPreceding, -1)
    centre = F.expr(f"cell * {width!r}D + s / m")
    placed = cells.select(
        *groups,
        "cell",
        "m",
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"),
        F.sum("m").over(whole).alias("n_rows"),
        F.coalesce(F.sum(F.expr("if(cell IS NULL, 0, m)")).over(whole), F.lit(0)).alias("n"),
        F.sum(F.col("m") * centre).over(whole).alias("_one"),
        F.sum(F.expr("ss - s * s / m") + F.col("m") * centre * centre).over(whole).alias("_two"),
        *[F.sum(x).over(whole).alias(x) for x in extras],
    )
    return placed.withColumns(
        {
            "mean": F.expr("try_divide(_one, CAST(n AS DOUBLE))"),
            "square": F.expr("_two - try_divide(_one * _one, CAST(n AS DOUBLE))"),
        }
    ).drop("_one", "_two")


def spread(n: Column, square: Column, sample: bool) -> Column:
    """Standard deviation from the squared deviations."""
    square = F.greatest(square, F.lit(0.0))
    if sample:
        return F.when(n > 1, F.sqrt(square / (n - 1)))
    return F.when(n > 0, F.sqrt(square / n))


def _position(p: float) -> str:
    """Zero-based interpolated position of a quantile among ``n`` values."""
    return f"(CAST({float(p)} AS DOUBLE) * CAST(n - 1 AS DOUBLE))"


def _ranks(probs: list[float]) -> Column:
    """Array of (index, lower rank, upper rank, weight), one per probability."""
    items = [
        f"named_struct('i', {i}, 'low', floor({x}), 'high', ceil({x}), 'weight', {x} - floor({x}))"
        for i, x in enumerate(map(_position, probs))
    ]
    return F.expr(f"array({', '.join(items)})")


def _holds_any(probs: list[float]) -> Column:
    """Whether a cell holds any wanted rank; cheap, so most cells stop here."""
    tests = [f"(ceil({x}) >= before AND floor({x}) < before + m)" for x in map(_position, probs)]
    return F.expr(" OR ".join(tests))


def _inside(rank: Column, before: Column, size: Column) -> Column:
    """Whether a zero-based rank falls among ``size`` rows after ``before`` rows."""
    return (rank >= before) & (rank < before + size)


def keep_wanted(cells: DataFrame, probs: list[float]) -> DataFrame:
    """Keep the histogram cells that hold a wanted rank, one row per rank.

    ``cells`` comes from :func:`histogram_totals`, whose ``m`` stays. A group
    without values keeps its null cell once.
    """
    near = cells.where((F.col("n") == 0) | _holds_any(probs))
    ranked = near.select("*", F.inline(_ranks(probs)))
    hit = _inside(F.col("low"), F.col("before"), F.col("m")) | _inside(
        F.col("high"), F.col("before"), F.col("m")
    )
    empty = (F.col("n") == 0) & (F.col("i") == 0)
    return ranked.where((F.col("cell").isNotNull() & hit) | empty)


def keep_parts(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the parts that hold the wanted rank of their cell; ``before`` moves up to them.

    ``sizes`` has a row per key (group, cell and rank ``i``) and ``part`` with its
    size ``m``, ``before``, ``low`` and ``high``.
    """
    upto = Window.partitionBy(*keys).orderBy(F.col("part").asc_nulls_first())
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("before") + F.coalesce(F.sum("m").over(earlier), F.lit(0))
    starts = sizes.withColumn("start", begin).withColumn("before", F.col("start"))
    hit = _inside(F.col("low"), F.col("start"), F.col("m")) | _inside(F.col("high"), F.col("start"), F.col("m"))
    return starts.where(hit | F.col("part").isNull()).drop("start")


def split_cells(counts: DataFrame, groups: list[str], width: float) -> DataFrame:
    """Keep of each kept cell the parts that hold the wanted rank; ``before`` moves up to them.

    Takes and returns rows as :func:`pick_values` needs them, plus the ``part``.
    At most ``SPLIT`` rows of a cell and rank pass through the window.
    """
    keys = [*groups, "cell", "i"]
    parted = counts.withColumn("part", part_of(F.col("v"), F.col("cell"), width))
    sizes = parted.groupBy(*keys, "part", "before", "low", "high").agg(F.sum("c").alias("m"))
    kept = keep_parts(sizes, keys).select(*keys, "part", F.col("before").alias("start")).alias("kept")
    joined = parted.alias("parted").join(kept, same(parted, kept, [*keys, "part"]))
    return joined.select(
        *[F.col(f"parted.`{c}`") for c in parted.columns if c != "before"], F.col("kept.start").alias("before")
    )


def pick_values(
    counts: DataFrame, groups: list[str], probs: list[float], carried: list[str]
) -> DataFrame:
    """Read the wanted ranks from value counts of the kept cells.

    ``counts`` has the group columns, ``cell``, ``part`` if the cells were split,
    ``before``, the rank columns, the value ``v`` and its multiplicity ``c``.
    Returns one row per group with the ``carried`` columns and ``q0 .. qk``.
    """
    part = ["part"] if "part" in counts.columns else []
    upto = (
        Window.partitionBy(*groups, "cell", "i", *part)
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.col("before") + F.coalesce(F.sum("c").over(upto), F.lit(0))
    placed = counts.withColumn("at", at)
    hits = placed.withColumns(
        {
            "_low": F.when(_inside(F.col("low"), F.col("at"), F.col("c")), F.col("v")),
            "_high": F.when(_inside(F.col("high"), F.col("at"), F.col("c")), F.col("v")),
        }
    )
    aggs = [F.max(c).alias(c) for c in carried]
    for i in range(len(probs)):
        aggs += [
            F.expr(f"max({part}) FILTER (WHERE i = {i}) AS {part}{i}")
            for part in ("_low", "_high", "weight")
        ]
    found = hits.groupBy(*groups).agg(*aggs)
    values = [
        F.expr(f"_low{i} + (_high{i} - _low{i}) * weight{i} AS q{i}") for i in range(len(probs))
    ]
    return found.select(*groups, *carried, *values)


def value_profile(
    df: DataFrame,
    groups: list[str],
    value: Column,
    probs: dict[str, float],
    width: float,
    carry: dict[str, Column] | None = None,
    extras: dict[str, Column] | None = None,
) -> DataFrame:
    """Distribution of a value per group, in one pass over the rows.

    Returns the group columns, ``n_rows``, ``n`` (rows with a value), ``mean``,
    ``std`` (sample), ``low``, ``high`` and one column per name in ``probs``.

    ``extras`` are further sums per group, written over the value ``v``, its
    multiplicity ``c`` and the flags in ``carry``.
    """
    keys, width = groups or ["_all"], width / FINE
    carry, extras = carry or {}, extras or {}
    names, levels = list(probs), list(probs.values())
    group_columns = [F.col(f"`{k}`") for k in groups] or [F.lit(1).alias("_all")]
    counts = (
        df.select(
            *group_columns,
            *[flag.alias(name) for name, flag in carry.items()],
            value.cast("double").alias("v"),
        )
        .groupBy(*keys, *carry, cell_of(F.col("v"), width).alias("cell"), "v")
        .agg(F.count("*").alias("c"))
    )
    off = offset(F.col("v"), F.col("cell"), width)
    per_cell = counts.groupBy(*keys, "cell").agg(
        F.sum("c").alias("m"),
        F.sum(F.col("c") * off).alias("s"),
        F.sum(F.col("c") * off * off).alias("ss"),
        *[F.sum(part).alias(name) for name, part in extras.items()],
    )
    cells = histogram_totals(per_cell, keys, width, tuple(extras))
    totals = ["n_rows", "n", "mean", "square", *extras]
    levels = [0.0, *levels, 1.0]
    kept = keep_wanted(cells, levels).alias("kept")
    shared = [*keys, "cell"]
    joined = counts.alias("counts").join(kept, same(counts, kept, shared))
    narrowed = joined.select(
        *[F.col(f"kept.{k}") for k in [*shared, "before", *RANK, *totals]],
        F.col("counts.v"),
        F.col("counts.c"),
    )
    found = pick_values(narrowed, keys, levels, totals)
    return found.select(
        *groups,
        "n_rows",
        "n",
        "mean",
        spread(F.col("n"), F.col("square"), sample=True).alias("std"),
        F.col("q0").alias("low"),
        F.col(f"q{len(levels) - 1}").alias("high"),
        *[F.col(f"q{i}").alias(k) for i, k in enumerate(names, start=1)],
        *extras,
    )
