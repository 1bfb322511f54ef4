"""State of every household at regular points in time.

A state holds from the first period point at or after its event until the next
event of the same key takes effect. Instead of repeating a state at every point
it covers, its start and end are recorded as +1/-1 moves in a (group, value cell)
histogram. Counts, means and deviations follow from cumulative moves; only the
states in the cells that hold a wanted quantile (of crowded cells, the distinct
values of the parts that do) are laid out over points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.columns import (
    as_instant,
    is_blank,
    last_value,
    normalised,
    round_to,
    same,
    week_start,
)
from hearthline.operators.quantiles import (
    RANK,
    cell_of,
    histogram_totals,
    keep_parts,
    keep_wanted,
    offset,
    part_of,
    pick_values,
    spread,
)
from hearthline.schema import (
    ENROLMENT,
    MASTER_BANDS,
    REMOVAL,
    SERIES_CELL,
    UNCLASSIFIED_SPELLINGS,
)

WEEKLY = "W-MON"
DAILY = "D"
SEGMENTS = ("milieu", "region", "genre_cm")
#: States of a cell at one point that one task may well look through.
CROWDED = 1 << 16
STATE_PROBS = {
    "low": 0.0,
    "p10": 0.10,
    "p25": 0.25,
    "median": 0.50,
    "p75": 0.75,
    "p90": 0.90,
    "high": 1.0,
}


def step_days(freq: str) -> int:
    """Days between two period points."""
    return 1 if (freq or WEEKLY).strip().upper() in {"D", "DAILY"} else 7


def period_of(ts: Column, step: int) -> Column:
    """Start of the period an instant lies in."""
    return ts.cast("date") if step == 1 else week_start(ts)


def effective_point(ts: Column, step: int) -> Column:
    """First period point at or after an instant."""
    start = period_of(ts, step)
    return F.when(as_instant(start) == ts, start).otherwise(F.date_add(start, step))


def last_point(dated: DataFrame, step: int, date: str = "date_calcul") -> Column:
    """Scalar: the last period point of the data."""
    return dated.agg(period_of(F.max(date), step).alias("last")).scalar()


def score_events(master: DataFrame, segments: tuple[str, ...] = ()) -> DataFrame:
    """Dated events with the score cleared where the household was removed."""
    kind = normalised(F.col("type_demande")) if "type_demande" in master.columns else F.lit("")
    tie = [F.col(c) for c in ("programme", "score_id_ano") if c in master.columns]
    return master.where(F.col("date_calcul").isNotNull() & F.col("menage_ano").isNotNull()).select(
        "menage_ano",
        "date_calcul",
        F.when(kind != REMOVAL, F.col("score_final")).alias("score"),
        (kind == ENROLMENT).alias("enrolled"),
        F.struct(F.col("date_calcul"), *tie).alias("seq"),
        *segments,
    )


def household_states(
    master: DataFrame, freq: str = WEEKLY, segments: tuple[str, ...] = ()
) -> DataFrame:
    """One row per household state: start point, stop point (exclusive) and score.

    A household first seen after the first instant of the data, through anything
    but an enrolment, is taken to have been present from the start with its first
    score; its events at that first instant are then spent.
    """
    step = step_days(freq)
    events = score_events(master, segments)
    origin = events.agg(F.min("date_calcul")).scalar()
    # Scalars enter through a projection: aggregate and window expressions cannot hold them.
    placed = events.withColumn("eff", effective_point(F.col("date_calcul"), step))
    # Order and state in one: smaller than a state beside its order, of which each side has both.
    event = F.struct("seq", "score", "enrolled", *segments)
    state = ("seq.date_calcul", "score", "enrolled", *segments)
    per_point = (
        placed.groupBy("menage_ano", "eff")
        .agg(F.min(event).alias("first"), F.max(event).alias("last"))
        .select(
            "menage_ano",
            "eff",
            *[F.struct(*[F.col(f"{side}.{c}") for c in state]).alias(side) for side in ("first", "last")],
        )
    )
    life = Window.partitionBy("menage_ano").orderBy("eff")
    lined = per_point.select(
        "*",
        F.row_number().over(life).alias("at"),
        F.lead("eff").over(life).alias("until"),
    ).withColumn("origin", origin)
    begin = effective_point(F.col("origin"), step)
    seeded = (
        (F.col("at") == 1)
        & ~F.col("first.enrolled")
        & (F.col("first.date_calcul") > F.col("origin"))
    )
    later = F.col("last.date_calcul") > F.col("first.date_calcul")
    first_state, last_state = (
        F.struct(F.col(f"{side}.score"), *[F.col(f"{side}.{s}") for s in segments]) for side in ("first", "last")
    )

    def span(start: Column, stop: Column, state: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), state.alias("state"))

    own = span(F.col("eff"), F.col("until"), last_state)
    spans = (
        F.when(~seeded, F.array(own))
        .when(~later, F.array(span(begin, F.col("until"), first_state)))
        .when(F.col("eff") == begin, F.array(own))
        .otherwise(F.array(span(begin, F.col("eff"), first_state), own))
    )
    return (
        lined.select("menage_ano", F.explode(spans).alias("span"))
        .select("menage_ano", "span.start", "span.stop", "span.state.*")
        .where(F.col("score").isNotNull())
        .withColumn("final", last_point(events, step))
        .where(F.col("start") <= F.col("final"))
        .withColumnRenamed("score", "v")
    )


def programme_states(master: DataFrame, freq: str = WEEKLY) -> DataFrame:
    """States per household and programme, with the distance to the threshold."""
    step = step_days(freq)
    named = master.where(~F.upper(F.trim("programme")).isin(*UNCLASSIFIED_SPELLINGS))
    kind = normalised(F.col("type_demande")) if "type_demande" in master.columns else F.lit("")
    tie = [F.col(c) for c in ("score_id_ano",) if c in master.columns]
    events = named.where(
        F.col("date_calcul").isNotNull() & F.col("menage_ano").isNotNull()
    ).select(
        "menage_ano",
        "programme",
        "date_calcul",
        effective_point(F.col("date_calcul"), step).alias("eff"),
        F.struct(
            F.when(kind != REMOVAL, F.col("score_final")).alias("score"),
            F.col("dist_threshold").alias("dist"),
        ).alias("state"),
        F.struct(F.col("date_calcul"), *tie).alias("seq"),
    )
    per_point = events.groupBy("menage_ano", "programme", "eff").agg(
        last_value(F.col("state"), F.col("seq")).alias("state")
    )
    life = Window.partitionBy("menage_ano", "programme").orderBy("eff")
    return (
        per_point.withColumn("stop", F.lead("eff").over(life))
        .select(
            "menage_ano",
            "programme",
            F.col("eff").alias("start"),
            "stop",
            F.col("state.score").alias("v"),
            F.col("state.dist").alias("dist"),
        )
        .where(F.col("v").isNotNull() & F.col("dist").isNotNull())
        .withColumn("final", last_point(events, step))
        .where(F.col("start") <= F.col("final"))
    )


def crowding(master: DataFrame, limit: int = CROWDED) -> int | None:
    """``limit`` if any cell of scores has more events than that, else none.

    Runs a job over the scores alone; a cell never has more states than events.
    """
    cells = master.where(F.col("score_final").isNotNull()).groupBy(cell_of(F.col("score_final"), SERIES_CELL))
    most = cells.count().agg(F.max("count")).first()[0]
    return limit if (most or 0) > limit else None


def moved(states: DataFrame, keys: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Changes, per key and point ``since``, of the number ``m`` of states and of sums over them."""
    ends = F.array(
        F.struct(F.col("start").alias("point"), F.lit(1).alias("sign")),
        F.struct(F.col("stop").alias("point"), F.lit(-1).alias("sign")),
    )
    return (
        states.select(*dict.fromkeys([*keys, "cell", "v"]), "final", F.explode(ends).alias("move"))
        .where(F.col("move.point") <= F.col("final"))
        .groupBy(*keys, "final", F.col("move.point").alias("since"))
        .agg(
            F.sum("move.sign").alias("m"),
            *[F.sum(F.col("move.sign") * x).alias(name) for name, x in (sums or {}).items()],
        )
    )


def steady(moves: DataFrame, keys: list[str], step: int, sums: list[str] | None = None) -> DataFrame:
    """Spans of points, ``since`` to ``upto``, in which the count ``m`` of a key does not change.

    ``moves`` has the key, the last point ``final``, ``since``, and the changes of
    ``m`` and of the ``sums`` at that point. Spans with a count of 0 are left out.
    """
    time = Window.partitionBy(*keys).orderBy("since")
    run = time.rowsBetween(Window.unboundedPreceding, 0)
    return moves.select(
        *keys,
        "since",
        F.coalesce(F.date_sub(F.lead("since").over(time), step), F.col("final")).alias("upto"),
        *[F.sum(c).over(run).alias(c) for c in ["m", *(sums or [])]],
    ).where("m > 0")


def _met(spans: DataFrame, kept: DataFrame, keys: list[str], own: str, size: str) -> DataFrame:
    """Kept cells or parts with the spans that cover their point: their value ``own`` and ``size``."""
    left, right = spans.alias("spans"), kept.alias("kept")
    covers = F.col("kept.point").between(F.col("spans.since"), F.col("spans.upto"))
    return left.join(right, same(left, right, keys) & covers).select(
        *[F.col(f"kept.{c}") for c in kept.columns if c != own],
        F.col(f"spans.{own}"),
        F.col("spans.m").alias(size),
    )


def _by_parts(
    placed: DataFrame, crowded: DataFrame, groups: list[str], step: int, width: float
) -> DataFrame:
    """Value counts of crowded cells, for the parts that hold the wanted rank.

    A second histogram over time tells the sizes of the parts at the points where
    the cell is crowded; distinct values of a part meet only the points that want it.
    """
    left = placed.alias("placed")
    # Report-sized: at most one row per group and histogram cell. Without crowded cells
    # adaptive execution drops this whole branch before it reads a state.
    full = F.broadcast(crowded.select(*groups, "cell").distinct()).alias("full")
    parted = left.join(full, same(left, full, [*groups, "cell"]), "left_semi").withColumn(
        "part", part_of(F.col("v"), F.col("cell"), width).cast("int")
    )
    part = [*groups, "cell", "part"]
    sizes = _met(steady(moved(parted, part), part, step), crowded, [*groups, "cell"], "part", "m")
    kept = keep_parts(sizes, [*groups, "point", "cell", "i"]).drop("m")
    return _met(steady(moved(parted, [*part, "v"]), [*part, "v"], step), kept, part, "v", "c")


def state_profile(
    states: DataFrame,
    groups: list[str],
    probs: dict[str, float],
    step: int,
    width: float = SERIES_CELL,
    crowded: int | None = None,
) -> DataFrame:
    """Distribution of the states alive at each period point.

    ``states`` has the group columns, ``start``, ``stop`` (null when open),
    ``final`` (last point) and the value ``v``. Returns the group columns,
    ``point``, ``n``, ``mean``, ``std_pop``, ``std`` and one column per prob.

    Only states in the cells that hold a wanted rank meet the points they cover.
    With ``crowded``, a cell with more states than that at a point is cut into
    parts there (see :func:`_by_parts`), at the price of reading the states again.
    """
    names = list(probs)
    levels = [probs[k] for k in names]
    cell = cell_of(F.col("v"), width)
    placed = states.select(*groups, "start", "stop", "final", "v", cell.alias("cell"))
    off = offset(F.col("v"), F.col("cell"), width)
    moves = moved(placed, [*groups, "cell"], {"s": off, "ss": off * off})
    grid = steady(moves, [*groups, "cell"], step, ["s", "ss"]).select(
        *groups,
        "cell",
        F.explode(
            F.sequence("since", "upto", F.make_interval(days=F.lit(step)))
        ).alias("point"),
        "m",
        "s",
        "ss",
    )
    cells = histogram_totals(grid, [*groups, "point"], width)
    totals = ["n", "mean", "square"]
    keys = [*groups, "point"]
    wanted = keep_wanted(cells, levels)
    carried = [*keys, "cell", "before", *RANK, *totals]
    easy = wanted if crowded is None else wanted.where(F.col("m") <= crowded)
    kept = easy.select(*carried).alias("kept")
    held = placed.alias("held")
    alive = (F.col("held.start") <= F.col("kept.point")) & (
        F.col("held.stop").isNull() | (F.col("kept.point") < F.col("held.stop"))
    )
    # Equal values of one wanted rank are collapsed before ranking.
    part = [] if crowded is None else [F.lit(-1).alias("part")]
    counts = (
        held.join(kept, same(held, kept, [*groups, "cell"]) & alive)
        .groupBy(*[F.col(f"kept.{k}") for k in carried], *part, F.col("held.v"))
        .agg(F.count("*").alias("c"))
    )
    if crowded is not None:
        full = wanted.where(F.col("m") > crowded).select(*carried)
        counts = counts.unionByName(_by_parts(placed, full, groups, step, width))
    found = pick_values(counts, keys, levels, totals)
    n, square = F.col("n"), F.col("square")
    return found.select(
        *keys,
        n,
        "mean",
        spread(n, square, sample=False).alias("std_pop"),
        spread(n, square, sample=True).alias("std"),
        *[F.col(f"q{i}").alias(k) for i, k in enumerate(names)],
    )


def build_score_timeseries(
    master: DataFrame,
    freq: str = WEEKLY,
    segments: tuple[str, ...] = (),
    percentiles: bool = True,
    crowded: int | None = None,
) -> DataFrame:
    """Score distribution of all active households at each period point.

    With ``segments`` the same state is also broken down by one dimension at a
    time; segment rows need two households and use the sample deviation. For
    ``crowded`` see :func:`state_profile` and :func:`crowding`.
    """
    segments = tuple(s for s in segments if s in master.columns)
    step = step_days(freq)
    states = household_states(master, freq, segments)
    members = [F.struct(F.lit("all").alias("dim"), F.lit(None).cast("string").alias("member"))]
    for s in segments:
        members.append(
            F.when(
                ~is_blank(F.col(s)),
                F.struct(F.lit(s).alias("dim"), F.col(s).cast("string").alias("member")),
            )
        )
    spread_out = states.select(
        "start", "stop", "final", "v", F.explode(F.array_compact(F.array(*members))).alias("g")
    ).select("start", "stop", "final", "v", "g.dim", "g.member")
    profile = state_profile(spread_out, ["dim", "member"], STATE_PROBS, step, crowded=crowded)
    overall = F.col("dim") == "all"

    def r(name: str) -> Column:
        return round_to(F.col(name), 6)

    return profile.where(overall | (F.col("n") >= 2)).select(
        as_instant(F.col("point")).alias("date_calcul"),
        *[F.when(F.col("dim") == s, F.col("member")).alias(s) for s in SEGMENTS],
        F.col("n").alias("n_menages"),
        r("mean").alias("score_mean"),
        r("median").alias("score_median"),
        round_to(F.when(overall, F.col("std_pop")).otherwise(F.col("std")), 6).alias("score_std"),
        r("low").alias("score_min"),
        r("high").alias("score_max"),
        *[
            (r(p) if percentiles else F.lit(None).cast("double")).alias(f"score_{p}")
            for p in ("p10", "p25", "p75", "p90")
        ],
    )


def band_suffix(band: float) -> str:
    """Column suffix of a band, e.g. 010 for 0.10 (truncated, as published)."""
    return f"{int(band * 100):03d}"


def band_suffixes(bands: tuple[float, ...]) -> dict[float, str]:
    """Suffix of each band; where truncation makes some equal, these get all their digits.

    0.28 and 0.29 (0.28999… in binary) become 0280 and 0290, 0.105 stays 010
    unless 0.10 is asked for too.
    """
    short = [band_suffix(b) for b in bands]
    digits = max((len(repr(float(b)).partition(".")[2]) for b in bands), default=2)
    return {
        b: s if short.count(s) == 1 else f"{round(b * 10 ** max(3, digits)):0{max(3, digits) + 1}d}"
        for b, s in zip(bands, short)
    }


def build_near_threshold_timeseries(
    master: DataFrame,
    bands: tuple[float, ...] = MASTER_BANDS,
    freq: str = WEEKLY,
    crowded: int | None = None,
) -> DataFrame:
    """Households close to the threshold, per period point and programme.

    For each band: all within it, those below (``neg``) and those above (``pos``)
    the threshold; a score exactly on the threshold counts in the first only. For
    ``crowded`` see :func:`state_profile` and :func:`crowding`.
    """
    step = step_days(freq)
    dist = F.col("dist")
    series = [(F.lit(True), "total")]
    for b, sfx in band_suffixes(tuple(dict.fromkeys(bands))).items():
        series += [
            (F.abs(dist) <= b, sfx),
            ((dist >= -b) & (dist < 0), f"{sfx}_neg"),
            ((dist > 0) & (dist <= b), f"{sfx}_pos"),
        ]
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in series]))
    states = programme_states(master, freq).select(
        "programme", "start", "stop", "final", "v", F.explode(names).alias("series")
    )
    profile = state_profile(states, ["programme", "series"], {"median": 0.5}, step, crowded=crowded)
    shown = profile.withColumns(
        {"mean": round_to(F.col("mean"), 6), "median": round_to(F.col("median"), 6)}
    )
    aggs = [F.expr("max(n) FILTER (WHERE series = 'total') AS n_total")]
    for _, name in series[1:]:
        here = f"FILTER (WHERE series = '{name}')"
        aggs += [
            F.expr(f"coalesce(max(n) {here}, 0L) AS n_near_{name}"),
            F.expr(f"max(mean) {here} AS mean_score_{name}"),
            F.expr(f"max(median) {here} AS median_score_{name}"),
        ]
    return (
        shown.groupBy(as_instant(F.col("point")).alias("week"), "programme").agg(*aggs)
    )
