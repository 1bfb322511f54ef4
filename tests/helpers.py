"""Frame construction for small fixtures."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = (
    "menage_ano long, programme string, date_calcul timestamp_ntz, score_id_ano long, "
    "type_demande string, score_final double"
)


def day(text):
    return None if text is None else datetime.fromisoformat(text)


def events(spark: SparkSession, rows) -> DataFrame:
    """Rows of (household, programme, date, id, type, score)."""
    data = [(h, p, day(d) if isinstance(d, str) else d, i, t, s) for h, p, d, i, t, s in rows]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def flagged(spark: SparkSession, rows) -> DataFrame:
    """Rows of (household, programme, date, eligible)."""
    return spark.createDataFrame(
        [(h, p, day(d), e) for h, p, d, e in rows],
        "menage_ano long, programme string, date_calcul timestamp_ntz, eligible boolean",
    )
