"""Per-household histories: timelines, trajectories, score changes, event lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.columns import (
    elapsed_days,
    first_value,
    last_value,
    lookup,
    ratio,
    round_to,
    unused,
)
from hearthline.operators.dedup import keep_one
from hearthline.operators.master import event_key
from hearthline.operators.sequence import with_previous
from hearthline.schema import (
    MIN_GAP_DAYS,
    REMOVAL,
    REQUEST_LABELS,
    TRAJECTORY_LABELS,
)


def build_household_timeline(master: DataFrame, score: str = "score_final") -> DataFrame:
    """Summary per household and programme."""
    keys = [c for c in ("menage_ano", "programme") if c in master.columns]
    key, value = event_key(master), F.col(score)
    aggs = [
        F.count(value).alias("n_events"),
        last_value(value, key, value.isNotNull()).alias("score_latest"),
        first_value(value, key, value.isNotNull()).alias("score_first"),
        F.min(value).alias("score_best"),
        F.max(value).alias("score_worst"),
        F.min("date_calcul").alias("date_first"),
        F.max("date_calcul").alias("date_last"),
    ]
    if "eligible" in master.columns:
        flag = F.col("eligible")
        aggs += [
            F.bool_or(flag).alias("ever_eligible"),
            last_value(flag, key, flag.isNotNull()).alias("currently_eligible"),
            first_value(flag, key, flag.isNotNull()).alias("first_eligible"),
        ]
    known = master
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return (
        known.groupBy(*keys)
        .agg(*aggs)
        .withColumn("days_active", elapsed_days(F.col("date_first"), F.col("date_last")))
    )


def build_household_trajectory(
    master: DataFrame,
    score: str = "score_final",
    status: bool = True,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Summary per household over all its programmes.

    With ``status`` the columns ``est_radie`` (ever removed) and ``statut_actuel``
    are added: removed if the last event is a removal, else by comparing the
    first, last and intermediate eligibility. ``previous`` is the result of
    :func:`previous_events` on the same events, where that is stored already.
    """
    key, value, flag = event_key(master), F.col(score), F.col("eligible")
    known = master.where(F.col("menage_ano").isNotNull())
    aggs = [
        F.count(value).alias("n_events"),
        last_value(value, key, value.isNotNull()).alias("score_actuel"),
        F.min(value).alias("score_min"),
        F.max(value).alias("score_max"),
        F.min("date_calcul").alias("date_premier"),
        F.max("date_calcul").alias("date_dernier"),
    ]
    has_flag = "eligible" in master.columns
    if has_flag:
        aggs += [
            first_value(flag, key, flag.isNotNull()).alias("eligible_inscription"),
            last_value(flag, key, flag.isNotNull()).alias("eligible_actuel"),
        ]
    derive = status and has_flag and "type_demande" in master.columns
    if derive:
        removed = F.lower(F.trim("type_demande")) == REMOVAL
        aggs += [
            F.coalesce(F.bool_or(removed), F.lit(False)).alias("est_radie"),
            last_value(F.coalesce(removed, F.lit(False)), key).alias("_gone"),
        ]
    base = known.groupBy("menage_ano").agg(*aggs)
    base = base.withColumn(
        "jours_dans_systeme", elapsed_days(F.col("date_premier"), F.col("date_dernier"))
    )
    if not derive:
        return base
    changes = eligibility_changes(known, previous)
    start, now = F.col("eligible_inscription"), F.col("eligible_actuel")
    status_now = (
        F.when(F.col("_gone"), F.lit(REMOVAL))
        .when(F.coalesce(F.col("n_changes"), F.lit(0)) > 1, F.lit("fluctuating"))
        .when(start & now, F.lit("stable_eligible"))
        .when(~start & ~now, F.lit("stable_excluded"))
        .when(now, F.lit("gained"))
        .otherwise(F.lit("lost"))
    )
    return (
        base.join(changes, "menage_ano", "left")
        .withColumn("statut_actuel", status_now)
        .drop("_gone", "n_changes")
    )


def eligibility_changes(master: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Number of eligibility changes between consecutive distinct dates of a household."""
    pairs = previous
    if pairs is None:
        dated = first_per_date(master.select(*_ordering_columns(master), "eligible"))
        pairs = with_previous(dated, ["menage_ano"], "date_calcul", [], ["eligible"])
    moved = F.col("previous.eligible") != F.col("eligible")
    return pairs.groupBy("menage_ano").agg(F.count_if(moved).alias("n_changes"))


def _ordering_columns(master: DataFrame) -> list[str]:
    return [
        c
        for c in ("menage_ano", "date_calcul", "programme", "score_id_ano")
        if c in master.columns
    ]


def first_per_date(
    master: DataFrame, looked: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """One row per household and date: the first by programme, then score id, then ``looked``.

    ``by`` names columns that stand for the date, if they are to be used in its place.
    """
    order = [c for c in ("programme", "score_id_ano") if c in master.columns]
    ties = [F.col(c).asc_nulls_last() for c in [*order, *(looked or [])]]
    return keep_one(master, ["menage_ano", *(by or ["date_calcul"])], ties or [F.lit(1)])


def _looked(master: DataFrame, score: str) -> list[str]:
    return [score, "date_calcul"] + (["eligible"] if "eligible" in master.columns else [])


def previous_events(master: DataFrame, score: str = "score_final") -> DataFrame:
    """Event dates of the households, and struct ``previous`` of what held at the date before.

    Only the columns that are looked at take part, so the shuffles are narrow.
    """
    looked = _looked(master, score)
    narrow = list(dict.fromkeys([*_ordering_columns(master), *looked]))
    dated = first_per_date(master.where(F.col("menage_ano").isNotNull()).select(*narrow), looked)
    kept = ["menage_ano", *looked]
    pairs = with_previous(dated.select(*kept), ["menage_ano"], "date_calcul", [], looked)
    return pairs.select(*[c for c in kept if c != score], "previous")


def _joined_previous(known: DataFrame, previous: DataFrame, looked: list[str]) -> DataFrame:
    """First row per household and date with its struct ``previous``, in one shuffle of the rows."""
    moment, undated, household, at, none = unused(known, "_moment", "_undated", "_household", "_at", "_none")
    date = F.col("date_calcul")
    # Columns without nulls stand for the date, so that join and choice of rows share a layout.
    some_day = F.lit("1970-01-01").cast(known.schema["date_calcul"].dataType)
    clock = {moment: F.coalesce(date, some_day), undated: date.isNull()}
    wide = first_per_date(known.withColumns(clock), looked, [moment, undated])
    before = previous.withColumns(clock).select(
        F.col("menage_ano").alias(household), F.col(moment).alias(at), F.col(undated).alias(none), "previous"
    )
    match = (F.col("menage_ano") == F.col(household)) & (F.col(moment) == F.col(at)) & (F.col(undated) == F.col(none))
    return wide.join(before, match).drop(moment, undated, household, at, none)


def build_delta_frame(
    master: DataFrame, score: str = "score_final", previous: DataFrame | None = None
) -> DataFrame:
    """Change between each event date of a household and the one before.

    All input columns are kept. With ``previous``, the stored result of
    :func:`previous_events` on the same events, they are shuffled once; without it
    they take part in finding what held before, in several shuffles, so select the
    needed ones first.
    """
    known = master.where(F.col("menage_ano").isNotNull())
    if previous is None:
        pairs = with_previous(first_per_date(known), ["menage_ano"], "date_calcul", [], _looked(master, score))
    else:
        pairs = _joined_previous(known, previous, _looked(master, score))

    def side(flag: Column) -> Column:
        return F.when(flag, F.lit("eligible")).when(~flag, F.lit("excluded"))

    before = F.col("previous")
    out = pairs.where(before[score].isNotNull()).withColumns(
        {
            "score_avant": before[score],
            "score_apres": F.col(score),
            "date_avant": before["date_calcul"],
            "date_apres": F.col("date_calcul"),
        }
    )
    if "eligible" in master.columns:
        out = out.withColumns(
            {"side_avant": side(before["eligible"]), "side_apres": side(F.col("eligible"))}
        )
    out = out.drop("previous").withColumns(
        {
            "delta_ISE": F.col("score_apres") - F.col("score_avant"),
            "abs_delta": F.abs(F.col("score_apres") - F.col("score_avant")),
            "days_between": elapsed_days(F.col("date_avant"), F.col("date_apres")),
        }
    )
    out = out.withColumn(
        "delta_distribue",
        F.when(
            F.col("days_between") > MIN_GAP_DAYS, ratio(F.col("delta_ISE"), F.col("days_between"))
        ),
    )
    if "eligible" not in master.columns:
        return out
    went, came = F.col("side_avant"), F.col("side_apres")
    return out.withColumn(
        "status_change",
        F.when((went == "excluded") & (came == "eligible"), F.lit("gained"))
        .when((went == "eligible") & (came == "excluded"), F.lit("lost"))
        .otherwise(F.lit("stable")),
    )


# --- household explorer -----------------------------------------------------


def household_history(master: DataFrame, household: int | None = None) -> DataFrame:
    """Event list per household with the score change since the previous event date.

    The change compares distinct event dates, so the rows an event has for its
    several programmes all show the same one.
    """
    chosen = master if household is None else master.where(F.col("menage_ano") == household)
    dated = first_per_date(
        chosen.select(*_ordering_columns(chosen), "score_final").where(
            F.col("menage_ano").isNotNull()
        )
    )
    steps = with_previous(dated, ["menage_ano"], "date_calcul", [], ["score_final"]).select(
        F.col("menage_ano").alias("_household"),
        F.col("date_calcul").alias("_date"),
        round_to(F.col("score_final") - F.col("previous.score_final"), 6).alias("delta_ise"),
    )
    shown = chosen.select(
        "menage_ano",
        "date_calcul",
        "score_id_ano",
        F.col("score_final").alias("score_final_corrige"),
        "score_calcule",
        "score_corrige",
        "was_corrected",
        F.col("type_demande").alias("canal"),
        "programme",
        "eligible",
        round_to(F.col("dist_threshold"), 6).alias("dist_threshold"),
        F.col("`near_0.10`").alias("near_10pct"),
        "region",
        "milieu",
        "taille_menage",
    )
    match = F.col("menage_ano").eqNullSafe(F.col("_household")) & F.col("date_calcul").eqNullSafe(
        F.col("_date")
    )
    return shown.join(steps, match, "left").drop("_household", "_date")


def household_profile(households: DataFrame, household: int | None = None) -> DataFrame:
    """Demographic description of one household, or of all."""
    chosen = (
        households if household is None else households.where(F.col("menage_ano") == household)
    )
    return chosen.select(
        "menage_ano",
        "region",
        "province",
        "commune",
        "milieu",
        "genre_cm",
        "type_menage",
        "taille_menage",
        "etat_matrimonial_cm",
        "date_naissance_cm",
    )


def household_latest(master: DataFrame) -> DataFrame:
    """Latest known score and eligibility per household and programme."""
    key, score, flag = event_key(master), F.col("score_final"), F.col("eligible")
    return (
        master.where(F.col("menage_ano").isNotNull() & F.col("programme").isNotNull())
        .groupBy("menage_ano", "programme")
        .agg(
            last_value(score, key, score.isNotNull()).alias("score_final_corrige"),
            last_value(flag, key, flag.isNotNull()).alias("eligible"),
        )
    )


def household_drift(master: DataFrame) -> DataFrame:
    """Difference between last and first score of a household, and its direction."""
    key, score = event_key(master), F.col("score_final")
    drift = round_to(last_value(score, key) - first_value(score, key), 4)
    return (
        master.where(F.col("menage_ano").isNotNull())
        .groupBy("menage_ano")
        .agg(drift.alias("drift"))
        .withColumn(
            "tendance",
            F.when(F.col("drift") < 0, F.lit("Amélioration"))
            .when(F.col("drift") > 0, F.lit("Dégradation"))
            .otherwise(F.lit("Stable")),
        )
    )


def label_events(history: DataFrame) -> DataFrame:
    """Event list as displayed: channel labels, Oui/Non flags, dd/MM/yyyy dates."""

    def yes_no(flag: Column) -> Column:
        return F.when(flag, F.lit("Oui")).when(~flag, F.lit("Non")).otherwise(F.lit("—"))

    return history.select(
        "menage_ano",
        "score_id_ano",
        F.date_format("date_calcul", "dd/MM/yyyy").alias("date"),
        "programme",
        lookup(F.col("canal"), REQUEST_LABELS).alias("canal"),
        "score_final_corrige",
        "score_calcule",
        "delta_ise",
        yes_no(F.col("eligible")).alias("eligible"),
        "dist_threshold",
        yes_no(F.col("was_corrected")).alias("was_corrected"),
    )


# --- trajectory KPIs --------------------------------------------------------


def radiated_households(trajectory: DataFrame) -> DataFrame:
    """Households removed for good: removed once and the last event is a removal."""
    if "est_radie" not in trajectory.columns:
        return trajectory.groupBy().agg(F.lit(0).cast("long").alias("n_radiated"))
    gone = F.col("est_radie")
    if "statut_actuel" in trajectory.columns:
        gone = gone & (F.col("statut_actuel") == REMOVAL)
    return trajectory.agg(F.count_if(gone).alias("n_radiated"))


def trajectory_status(trajectory: DataFrame) -> DataFrame:
    """Households per current status, largest first."""
    return (
        trajectory.groupBy(F.col("statut_actuel").alias("code"))
        .agg(F.count("*").alias("n_menages"))
        .withColumn("statut", lookup(F.col("code"), TRAJECTORY_LABELS))
        .orderBy(F.desc("n_menages"), "code")
    )
