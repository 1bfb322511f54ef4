"""Household counts by demographic attribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hearthline.functions.columns import ratio, round_to
from hearthline.schema import MAX_HISTOGRAM_SIZE


def households_by(households: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Households per category; missing values are a category of their own."""
    order = F.asc("n_menages") if ascending else F.desc("n_menages")
    return (
        households.groupBy(column).agg(F.count("*").alias("n_menages")).orderBy(order, column)
    )


def household_size(households: DataFrame, max_size: int = MAX_HISTOGRAM_SIZE) -> DataFrame:
    """Households per size up to ``max_size`` persons, as published."""
    return (
        households.where(F.col("taille_menage") <= max_size)
        .groupBy("taille_menage")
        .agg(F.count("*").alias("n_menages"))
        .orderBy("taille_menage")
    )


def top_provinces(households: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` provinces with most households, smallest of them first."""
    counts = households.groupBy("province").agg(F.count("*").alias("n_menages"))
    return counts.orderBy(F.desc("n_menages"), "province").limit(k).orderBy("n_menages", "province")


def demog_mode_share(households: DataFrame) -> DataFrame:
    """Most frequent category of area, gender and household type, with its share."""

    def mode(column: str) -> DataFrame:
        counts = households.groupBy(column).agg(F.count("*").alias("n"))
        # most frequent first, alphabetical among equals
        best = F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column)))
        return counts.agg(
            F.lit(column).alias("attribut"),
            best.alias("categorie"),
            F.max("n").alias("n_menages"),
            round_to(ratio(F.max("n"), F.sum("n")) * 100, 4).alias("pct"),
        )

    return reduce(DataFrame.unionByName, [mode(c) for c in ("milieu", "genre_cm", "type_menage")])


def mean_household_size(households: DataFrame) -> DataFrame:
    """Mean size over all households that state one, however large."""
    size = F.col("taille_menage")
    return households.agg(round_to(ratio(F.sum(size), F.count(size)), 4).alias("taille_moyenne"))


def region_coverage(households: DataFrame, share: float = 0.70) -> DataFrame:
    """Fewest regions, largest first, that together reach the given share.

    The running total goes over one row per region.
    """
    counts = households.groupBy("region").agg(F.count("*").alias("n_menages")).withColumn(
        "_all", F.lit(1)
    )
    ranked = Window.partitionBy("_all").orderBy(F.desc("n_menages"), F.asc_nulls_last("region"))
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n_menages").over(Window.partitionBy("_all"))
    running = F.sum("n_menages").over(upto)
    return (
        counts.select(
            F.row_number().over(ranked).cast("long").alias("rang"),
            "region",
            "n_menages",
            running.alias("cumul"),
            total.alias("total"),
        )
        .where((F.col("cumul") - F.col("n_menages")) / F.col("total") < share)
        .select(
            "rang",
            "region",
            "n_menages",
            round_to(F.col("cumul") / F.col("total") * 100, 4).alias("pct_cumul"),
        )
    )
