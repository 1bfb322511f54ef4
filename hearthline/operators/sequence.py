"""Look at the preceding row of a key without gathering the key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hearthline.functions.columns import unused

#: Values of the first tie that rows without a date share a task for.
UNDATED = 1 << 14


def with_previous(
    df: DataFrame,
    keys: list[str],
    date: str,
    ties: list[str],
    values: list[str],
    name: str = "previous",
) -> DataFrame:
    """Add struct ``name`` holding ``values`` of the preceding row of the same key.

    Rows are ordered by ``date`` (missing last) and ``ties``. The key is cut into
    clock minutes: inside a minute the previous row comes from a window over
    (key, minute); only the first row of each minute then looks back over the
    minutes of its key, each of which contributes a single row. Rows without a
    date are cut by the first tie, if that is a whole number, into ranges of
    ``UNDATED`` values. A key that holds a large share of all rows is thus spread
    over as many tasks as it has minutes and ranges.
    """
    day, hour, slot, at, closing = helpers = unused(df, "_day", "_hour", "_slot", "_at", "_closing")
    moment = F.col(date)
    whole_number = bool(ties) and isinstance(df.schema[ties[0]].dataType, T.IntegralType)
    undated = F.floor(F.col(ties[0]) / UNDATED) if whole_number else F.lit(None)
    clock = [
        moment.cast("date").alias(day),
        F.hour(moment).alias(hour),
        F.when(moment.isNull(), undated.cast("long")).otherwise(F.minute(moment)).alias(slot),
    ]
    order = [moment.asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    inside = Window.partitionBy(*keys, day, hour, slot).orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*[F.col(f"`{v}`") for v in values])
    cut = df.select("*", *clock).select(
        "*",
        F.row_number().over(inside).alias(at),
        F.lag(row).over(inside).alias(name),
        F.last(row).over(whole).alias(closing),
    )
    follow = cut.where(F.col(at) > 1)
    across = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in (day, hour, slot)])
    lead = cut.where(F.col(at) == 1).withColumn(name, F.lag(closing).over(across))
    return follow.unionByName(lead).drop(*helpers)


def running_total(value: Column, groups: list[str], order: str) -> Column:
    """Cumulative sum over pre-aggregated rows of each group."""
    span = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(span)
