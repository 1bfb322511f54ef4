"""Keep one row per key.

``row_number() = 1`` is planned with a group limit in front of the shuffle, so
each map task sends at most one row per key and a key with many copies does not
gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.columns import unused


def keep_one(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """First row per key in the given order; a null key is a key of its own."""
    pick = Window.partitionBy(*keys).orderBy(*order)
    (number,) = unused(df, "_pick")
    return df.withColumn(number, F.row_number().over(pick)).where(F.col(number) == 1).drop(number)


def keep_one_keep_null(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """As :func:`keep_one`, but rows without a key are all kept, each a group of its own."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    (own,) = unused(df, "_alone")
    return keep_one(df.withColumn(own, alone), [key, own], order).drop(own)
