"""Registry sources derived from the order/customer test tables.

Every value is computed from the tables with plain expressions. Scores come
from a square root, so that rounded results do not sit on rounding ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.schema import MAX_SCORE
from hearthline.sources.csv import final_score, score_postprocess

FAMILY_STATES = ("Marié(e)", "Célibataire", "Divorcé(e)", "Séparé(e)")
PRIORITY_TYPES = {
    "1": "inscription",
    "2": "mise à jour du dossier",
    "3": "révision de score",
    "4": "réclamation",
    "5": "radiation",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def households(spark: SparkSession, folder: str) -> DataFrame:
    """Household file from customers with their nation and region."""
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    urban = F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("menage_ano"),
        F.when(urban, F.lit("Urbain")).otherwise(F.lit("Rural")).alias("milieu"),
        F.col("r_regionkey").cast("long").alias("region_id"),
        F.when(key % 97 != 0, F.col("r_name")).alias("region"),
        F.col("n_nationkey").cast("long").alias("province_id"),
        F.col("n_name").alias("province"),
        (key % 50).alias("commune_id"),
        F.concat(F.col("n_name"), F.lit("-"), (key % 5).cast("string")).alias("commune"),
        F.col("c_mktsegment").alias("type_menage"),
        (key % 14 + 1).alias("taille_menage"),
        F.element_at(
            F.array(*[F.lit(s) for s in FAMILY_STATES]), (key % 4 + 1).cast("int")
        ).alias("etat_matrimonial_cm"),
        F.when(key % 2 == 0, F.lit("Homme")).otherwise(F.lit("Femme")).alias("genre_cm"),
        (key % 2 + 1).alias("sexe_id"),
        F.date_add(F.lit("1950-01-01").cast("date"), (key % 20000).cast("int"))
        .cast("timestamp_ntz")
        .alias("date_naissance_cm"),
    )


def score_of(price: Column) -> Column:
    """Score below 16, falling with the amount."""
    return F.lit(16.0) - F.sqrt(price) / F.lit(75.0)


def _score_columns() -> list[Column]:
    kind = F.create_map(*[F.lit(x) for kv in PRIORITY_TYPES.items() for x in kv])
    score = score_of(F.col("o_totalprice"))
    return [
        F.col("o_custkey").alias("menage_ano"),
        F.col("o_orderkey").alias("score_id_ano"),
        kind[F.left(F.col("o_orderpriority"), F.lit(1))].alias("type_demande"),
        F.when(F.col("o_orderkey") % 10 == 0, score - F.lit(0.1)).alias("score_corrige"),
        score.alias("score_calcule"),
        F.col("o_orderdate").alias("date_calcul"),
    ]


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Score file from orders, as it would be read: no row removed."""
    return table(spark, folder, "orders").select(*_score_columns())


def score_rows_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Score rows and changed copies of every fiftieth, with their line number."""
    rows = score_rows(spark, folder)
    line = F.col("score_id_ano") * 2
    shift = F.when(F.col("score_id_ano") % 100 == 0, F.expr("interval 3 days")).otherwise(
        F.expr("interval -3 days")
    )
    copies = rows.where(F.col("score_id_ano") % 50 == 0).withColumns(
        {
            "score_calcule": F.col("score_calcule") + F.lit(0.25),
            "date_calcul": F.col("date_calcul") + shift,
            "line_no": line + 1,
        }
    )
    return rows.withColumn("line_no", line).unionByName(copies)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned score events."""
    return score_postprocess(score_rows(spark, folder), MAX_SCORE)


def unfiltered_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score events with their final score, outliers kept."""
    return final_score(score_rows(spark, folder))


def programmes(spark: SparkSession, folder: str) -> DataFrame:
    """Programme membership, zero to three programmes per household."""
    key = F.col("c_custkey")
    rules = {"AMOT": key % 3 == 0, "ASD": key % 4 == 0, "AMOA": key % 11 == 0}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return table(spark, folder, "customer").select(
        key.alias("menage_ano"), F.explode(names).alias("programme")
    )


def beneficiaries(spark: SparkSession, folder: str) -> DataFrame:
    """Beneficiary status changes from orders."""
    partner = F.when(F.col("o_custkey") % 2 == 0, F.lit("AMOT")).otherwise(F.lit("ASD"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("menage_ano"),
        partner.alias("partner_id"),
        F.col("o_orderpriority").alias("motif"),
        F.col("o_orderdate").alias("date_insert"),
        (F.col("o_orderstatus") == "O").alias("actif"),
    )


def silent_households(spark: SparkSession, folder: str) -> DataFrame:
    """Households that never had a score: suppliers, numbered above the customers."""
    return table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + F.lit(1_000_000_000)).cast("long").alias("menage_ano")
    )
