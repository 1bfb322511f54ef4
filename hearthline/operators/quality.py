"""Data-quality accounting and volume counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.columns import elapsed_days, is_blank, lookup, ratio, round_to
from hearthline.schema import MAX_SCORE, QC_TEXTS, SNAPSHOT_LABELS, UNCLASSIFIED


def side_by_side(counters: dict[str, DataFrame]) -> DataFrame:
    """One row with the single value of each one-row frame, under its name."""
    named = [
        df.select(F.lit(name).alias("name"), F.col(f"`{df.columns[0]}`").cast("long").alias("value"))
        for name, df in counters.items()
    ]
    stacked = reduce(DataFrame.unionByName, named)
    return stacked.groupBy().agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in counters]
    )


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame."""
    return df.groupBy().agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct known values as a one-row frame."""
    return df.agg(F.countDistinct(column).alias("n"))


def households_without_score(households: DataFrame, master: DataFrame) -> DataFrame:
    """Households that have no event.

    Event households are made distinct first, so one with very many events
    reaches the join as a single row.
    """
    return households.join(master.select("menage_ano").distinct(), "menage_ano", "left_anti")


def pct_dropped(dropped: Column, before: Column) -> Column:
    """Dropped rows in percent of the rows before; zero when there were none."""
    return F.coalesce(round_to(ratio(dropped, before) * 100, 4), F.lit(0.0))


def qc_metrics(
    raw_scores: DataFrame,
    scores: DataFrame,
    raw_households: DataFrame,
    households: DataFrame,
    master: DataFrame,
    max_score: float = MAX_SCORE,
    rejected: DataFrame | None = None,
    records: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows before and after each cleaning step.

    ``raw_scores`` are the score rows as read, with ``score_final`` computed but
    nothing removed; scores above the limit are counted there. ``rejected`` has
    the ``source`` of every record that could not be read: those of scores and
    households are part of the raw rows, and each source in ``records`` (one-row
    frames with its number of physical records) gets a line of its own.
    """
    records = records or {}
    unclassified = F.when(F.col("programme") == UNCLASSIFIED, F.col("menage_ano"))
    raw = raw_scores.agg(
        F.count("*").alias("n"), F.count_if(F.col("score_final") > max_score).alias("over")
    )
    seen = master.agg(
        F.countDistinct("menage_ano").alias("n"), F.countDistinct(unclassified).alias("none")
    )
    counts = side_by_side(
        {
            "raw_scores": raw.select("n"),
            "over_limit": raw.select("over"),
            "scores": row_count(scores),
            "raw_households": row_count(raw_households),
            "households": row_count(households),
            "no_score": row_count(households_without_score(households, master)),
            "seen": seen.select("n"),
            "unclassified": seen.select("none"),
            **{f"records_{name}": df for name, df in records.items()},
            **{f"rejected_{name}": row_count(rejected.where(F.col("source") == name)) for name in records},
        }
    )
    c = F.col
    zero = F.lit(0).cast("long")
    lost_scores = F.greatest(c("raw_scores") - c("scores"), zero)
    lost_households = F.greatest(c("raw_households") - c("households"), zero)
    unread = {name: c(f"rejected_{name}") if name in records else zero for name in ("scores", "menage")}

    def line(metric: str, before: Column, after: Column, dropped: Column) -> Column:
        label, note = QC_TEXTS[metric]
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(label).alias("label_fr"),
            before.alias("before"),
            after.alias("after"),
            dropped.alias("dropped"),
            pct_dropped(dropped, before).alias("pct_dropped"),
            F.lit(note.format(limit=max_score)).alias("note"),
        )

    raw_s, raw_h, h = c("raw_scores"), c("raw_households"), c("households")
    over, lonely, loose = c("over_limit"), c("no_score"), c("unclassified")
    lines = [
        line("scores_raw_rows", raw_s + unread["scores"], c("scores"), lost_scores + unread["scores"]),
        line("scores_duplicate_rows", raw_s, raw_s - lost_scores, lost_scores),
        line("scores_aberrant", raw_s, raw_s - over, over),
        line("menage_raw_rows", raw_h + unread["menage"], h, lost_households + unread["menage"]),
        line("menage_duplicate_ids", raw_h, h, lost_households),
        line("menage_no_score", h, h - lonely, lonely),
        line("menage_non_classifie", c("seen"), c("seen") - loose, loose),
    ]
    for name in records:
        before, lost = c(f"records_{name}"), c(f"rejected_{name}")
        lines.append(line(f"{name}_rejected_rows", before, before - lost, lost))
    return counts.select(F.inline(F.array(*lines)))


def score_period(scores: DataFrame) -> DataFrame:
    """First and last score date and the days between them."""
    first, last = F.min("date_calcul"), F.max("date_calcul")
    return scores.where(F.col("date_calcul").isNotNull()).agg(
        first.alias("date_min"), last.alias("date_max"), elapsed_days(first, last).alias("jours")
    )


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first per known identifier."""
    return df.where(F.col(column).isNotNull()).agg(
        (F.count("*") - F.countDistinct(column)).alias("n_dupes")
    )


def qc_dupes(scores: DataFrame, households: DataFrame) -> DataFrame:
    """Duplicate score and household identifiers."""
    return side_by_side(
        {
            "qc_score_dupes": duplicate_ids(scores, "score_id_ano"),
            "qc_menage_dupes": duplicate_ids(households, "menage_ano"),
        }
    )


def qc_aberrant(scores: DataFrame, master: DataFrame) -> DataFrame:
    """Score rows that exceed the master rows, never below zero."""
    counts = side_by_side({"scores": row_count(scores), "master": row_count(master)})
    gap = F.greatest(F.col("scores") - F.col("master"), F.lit(0).cast("long"))
    return counts.select(gap.alias("qc_aberrant_scores"))


def qc_blank_fields(households: DataFrame) -> DataFrame:
    """Households without region or area."""
    return households.agg(
        F.count_if(is_blank(F.col("region"))).alias("qc_null_region"),
        F.count_if(is_blank(F.col("milieu"))).alias("qc_null_milieu"),
    )


def programme_rows(programmes: DataFrame) -> DataFrame:
    """Membership rows per programme."""
    return programmes.groupBy(F.upper("programme").alias("programme")).agg(
        F.count("*").alias("n_rows")
    )


def volume_kpis(
    scores: DataFrame, households: DataFrame, delta: DataFrame, master: DataFrame
) -> DataFrame:
    """Events, households, transitions and households with an event."""
    return side_by_side(
        {
            "n_score_events": row_count(scores),
            "n_menages": row_count(households),
            "n_transitions": row_count(delta),
            "n_menages_uniq": distinct_count(master, "menage_ano"),
        }
    )


def beneficiary_stats(beneficiaries: DataFrame) -> DataFrame:
    """Records, distinct households and active records."""
    return beneficiaries.agg(
        F.count("*").alias("n_total"),
        F.countDistinct("menage_ano").alias("n_uniq"),
        F.count_if("actif").alias("n_actif"),
    )


def coverage_ratios(programme_counts: DataFrame, matched: DataFrame) -> DataFrame:
    """Households with events in percent of the rows listed, per programme."""
    return programme_counts.join(
        matched.select("programme", "n_menages"), "programme", "left"
    ).select(
        "programme",
        "n_rows",
        F.coalesce("n_menages", F.lit(0)).alias("n_menages"),
        F.coalesce(
            round_to(ratio(F.col("n_menages"), F.col("n_rows")) * 100, 4), F.lit(0.0)
        ).alias("pct_match"),
    )


def records_per_beneficiary(stats: DataFrame) -> DataFrame:
    """Beneficiary records per household."""
    return stats.select(
        "n_total",
        "n_uniq",
        F.coalesce(round_to(ratio(F.col("n_total"), F.col("n_uniq")), 1), F.lit(0.0)).alias(
            "avg_records"
        ),
    )


def snapshot_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named frame, with its description."""

    def entry(name: str, df: DataFrame) -> DataFrame:
        counted = df.groupBy().agg(F.count("*").alias("lignes"))
        return counted.select(F.lit(name).alias("fichier"), "lignes")

    listed = reduce(DataFrame.unionByName, [entry(n, d) for n, d in sorted(frames.items())])
    return listed.select(
        "fichier", lookup(F.col("fichier"), SNAPSHOT_LABELS).alias("description"), "lignes"
    )
