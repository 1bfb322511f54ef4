"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the frame has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled value, as SQL engines do for doubles."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sequence_key(date: Column, *ties: Column) -> Column:
    """Ordering key that puts missing dates last and breaks ties by the given columns."""
    return F.struct(date.isNull(), date, *ties)


def last_value(value: Column, key: Column, when: Column | None = None) -> Column:
    """Aggregate: value at the greatest key, optionally only over rows where ``when`` holds."""
    return F.max_by(value, key if when is None else F.when(when, key))


def first_value(value: Column, key: Column, when: Column | None = None) -> Column:
    """Aggregate: value at the smallest key, optionally only over rows where ``when`` holds."""
    return F.min_by(value, key if when is None else F.when(when, key))


def truth(flag: Column) -> Column:
    """Three-valued flag to two-valued: unknown counts as false."""
    return F.coalesce(flag, F.lit(False))


def lookup(value: Column, labels: dict[str, str]) -> Column:
    """Replace known values by their label and keep the others."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[value], value)


def same(left, right, names: list[str]) -> Column:
    """Null-safe equi-join condition over equally named columns of two frames."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def week_start(ts: Column) -> Column:
    """Monday of the calendar week, as a date."""
    day = ts.cast("date")
    return F.date_sub(day, F.weekday(day))


def month_start(ts: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(ts.cast("date"), "MM")


def as_instant(day: Column) -> Column:
    """Midnight of a date as a zone-less timestamp."""
    return day.cast("timestamp_ntz")


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole 24 h periods between two instants (not calendar days)."""
    return F.timestamp_diff("DAY", earlier, later)


def is_blank(text: Column) -> Column:
    """Missing or only whitespace."""
    return text.isNull() | (F.trim(text) == "")


def normalised(text: Column) -> Column:
    """Lower-cased, trimmed text; missing becomes empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


#: Categories that may become columns or tables of their own.
MAX_COLUMNS = 500


def category_values(df: DataFrame, column: str) -> tuple[str, ...]:
    """Distinct values of a category column, sorted, nulls left out.

    At most ``MAX_COLUMNS`` of them reach the driver; more are an error, since a
    column of free text is no list of categories.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1)
    values = sorted(r[0] for r in found.collect())
    if len(values) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    return tuple(values)
