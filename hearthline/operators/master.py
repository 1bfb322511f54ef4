"""Fact table of score events and its direct derivatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.columns import category_values, last_value, month_start, same, sequence_key, truth, unused
from hearthline.schema import MASTER_BANDS, PROGRAMME_THRESHOLDS, UNCLASSIFIED


def threshold_of(programme: Column, thresholds: dict[str, float]) -> Column:
    """Eligibility threshold of a programme, null when it has none."""
    chain = F.lit(None).cast("double")
    for name, value in thresholds.items():
        chain = F.when(programme == name, F.lit(value)).otherwise(chain)
    return chain


def event_key(df: DataFrame) -> Column:
    """Total order of a household's events: date, programme, score id."""
    ties = [F.col(c) for c in ("programme", "score_id_ano") if c in df.columns]
    return sequence_key(F.col("date_calcul"), *ties)


def join_households(scores: DataFrame, households: DataFrame) -> DataFrame:
    """Attach household columns; names already taken get the suffix ``_menage``."""
    taken = set(scores.columns) - {"menage_ano"}
    left, right = scores.alias("s"), households.alias("h")
    kept = [
        F.col(f"h.`{c}`").alias(f"{c}_menage" if c in taken else c)
        for c in households.columns
        if c != "menage_ano"
    ]
    return left.join(right, same(left, right, ["menage_ano"]), "left").select("s.*", *kept)


def join_programmes(events: DataFrame, programmes: DataFrame | None) -> DataFrame:
    """One row per event and programme of the household; none becomes unclassified."""
    if programmes is None:
        return events.withColumn("programme", F.lit(UNCLASSIFIED))
    left, right = events.alias("e"), programmes.alias("p")
    joined = left.join(right, same(left, right, ["menage_ano"]), "left")
    return joined.select(
        "e.*", F.upper(F.coalesce("p.programme", F.lit(UNCLASSIFIED))).alias("programme")
    )


def add_threshold_flags(
    events: DataFrame, thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Threshold, distance to it, eligibility and proximity flags (never null)."""
    limit = threshold_of(F.col("programme"), thresholds or PROGRAMME_THRESHOLDS)
    placed = events.withColumn("threshold", limit)
    placed = placed.withColumn("dist_threshold", F.col("score_final") - F.col("threshold"))
    dist = F.col("dist_threshold")
    flags = {"eligible": truth(dist < 0)}
    flags |= {f"near_{b:.2f}": truth(F.abs(dist) <= b) for b in MASTER_BANDS}
    return placed.withColumns(flags)


def build_master_events(
    scores: DataFrame,
    households: DataFrame | None = None,
    programmes: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
    lay_out: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score events with household attributes, programme and eligibility.

    Both joins use the household key, so the events are shuffled once for the
    two of them. Leave ``households`` out when no attribute is needed. ``lay_out``
    orders the rows before the flags are added, which then need no shuffle.
    """
    events = scores if households is None else join_households(scores, households)
    joined = join_programmes(events, programmes)
    return add_threshold_flags(lay_out(joined) if lay_out else joined, thresholds)


def build_programme_frame(master: DataFrame, programme: str) -> DataFrame:
    """Events of one programme."""
    if "programme" not in master.columns:
        raise ValueError("the event frame has no programme column")
    return master.where(F.col("programme") == programme.upper())


def build_beneficiary_events(master: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    """Events with every earlier beneficiary record of the household.

    An event of a household that has only later records disappears, one of a
    household without any stays. Records lie in months; an event names the months
    of its household's records up to its own and meets only the records of these,
    so later records are never paired and a household with very many records is
    dealt out by month.
    """
    renamed = {
        "partner_id": "beneficiaire_partner_id",
        "motif": "beneficiaire_motif",
        "actif": "beneficiaire_actif",
        "date_insert": "beneficiaire_date_insert",
    }
    taken = set(master.columns) - {"menage_ano"}
    left, right = master.alias("m"), beneficiaries.alias("b")
    kept = [
        F.col(f"b.`{c}`").alias(
            renamed.get(c, f"{c}_beneficiaire" if c in taken else c)
        )
        for c in beneficiaries.columns
        if c != "menage_ano"
    ]
    if "date_insert" not in beneficiaries.columns or "date_calcul" not in master.columns:
        return left.join(right, same(left, right, ["menage_ano"]), "left").select("m.*", *kept)
    # Records without a date belong to every event; they have a month of their own.
    undated = F.lit("0001-01-01").cast("date")
    month, event = unused(beneficiaries, "_month", "_event")
    dated = beneficiaries.withColumn(month, F.coalesce(month_start(F.col("date_insert")).cast("date"), undated)).alias("b")
    months = beneficiaries.groupBy("menage_ano").agg(
        F.collect_set(F.coalesce(month_start(F.col("date_insert")).cast("date"), undated)).alias("months")
    ).alias("n")
    known = left.join(months, same(left, months, ["menage_ano"]), "left")
    whole = F.struct("m.*").alias(event)
    reached = F.filter("n.months", lambda x: (x == undated) | (x <= F.col("m.date_calcul").cast("date")))
    alone = known.where(F.col("n.months").isNull()).select(whole)
    met = known.where(F.col("n.months").isNotNull()).select(whole, F.explode(reached).alias("reached")).alias("e")
    inserted = F.col("b.date_insert")
    paired = met.join(
        dated,
        F.col(f"e.{event}.menage_ano").eqNullSafe(F.col("b.menage_ano"))
        & (F.col("e.reached") == F.col(f"b.`{month}`"))
        & (inserted.isNull() | (inserted <= F.col(f"e.{event}.date_calcul"))),
    ).select(f"e.{event}", *kept)
    both = paired.unionByName(alone, allowMissingColumns=True)
    return both.select(f"{event}.*", *[F.col(f"`{c}`") for c in both.columns if c != event])


def build_pivot_wide(
    master: DataFrame,
    score: str = "score_final",
    pivot: str = "type_demande",
    how: str = "last",
    values: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per household and programme with one score column per request type.

    Without ``values`` the types present make the columns. A given list fixes the
    columns, not the rows: a household without any of these types has nulls.
    """
    if values is None:
        values = pivot_values(master, pivot)
    keys = [c for c in ("menage_ano", "programme") if c in master.columns]
    key = event_key(master)
    target = F.col(score)

    def cell(value: str) -> Column:
        here = F.col(pivot) == value
        seen = here & target.isNotNull()
        if how == "last":
            return last_value(target, key, seen)
        if how == "first":
            return F.min_by(target, F.when(seen, key))
        inner = F.when(here, target)
        return {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}[how](inner)

    return (
        master.where(F.col("menage_ano").isNotNull())
        .groupBy(*keys)
        .agg(*[cell(v).alias(f"score_{v}") for v in values])
    )


def pivot_values(master: DataFrame, pivot: str = "type_demande") -> tuple[str, ...]:
    """Values present, sorted, for use as columns; an error beyond ``MAX_COLUMNS`` of them."""
    return category_values(master, pivot)
