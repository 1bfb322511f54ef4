"""User-defined calculations and aggregates over named frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.sources.snapshots import FrameMap, readable_snapshots

Calculation = Callable[[FrameMap], DataFrame]


def run_calculations(base: FrameMap, calculations: Mapping[str, Calculation]) -> FrameMap:
    """The base frames and one derived frame per calculation, in the given order.

    A calculation may use everything before it.
    """
    known = {**base}
    for name, derive in calculations.items():
        known |= {name: _frame(derive(known), name)}
    return known


def _frame(value: Any, name: str) -> DataFrame:
    if isinstance(value, DataFrame):
        return value
    raise TypeError(f"{name} gave a {type(value).__name__} where a DataFrame is needed")


def _sql_frame(spark: SparkSession, text: str, frames: FrameMap, args: dict[str, Any] | None) -> DataFrame:
    """SQL in which ``{name}`` stands for a frame."""
    named = {name: df for name, df in frames.items() if f"{{{name}}}" in text}
    return spark.sql(text, args=args, **named)


def run_aggregations(
    spark: SparkSession,
    aggregations: Mapping[str, Calculation | str],
    frames: FrameMap | None = None,
    folder: str | None = None,
    args: dict[str, Any] | None = None,
    output: str | None = None,
) -> FrameMap:
    """Named aggregates given as functions of the frames or as SQL over them.

    The frames are given, or are the readable snapshots of ``folder``. With
    ``output`` each result is written as its own table next to ``_catalog``,
    which lists the frame names, the names of unreadable snapshots, and the time.
    """
    unknown = [k for k, a in aggregations.items() if not (callable(a) or isinstance(a, str))]
    if unknown:
        raise TypeError(f"neither SQL nor a function: {', '.join(unknown)}")
    skipped: list[str] = []
    if frames is None:
        if folder is None:
            raise ValueError("frames or a snapshot folder are needed")
        frames, skipped = readable_snapshots(spark, folder)
    results = {
        key: _sql_frame(spark, how, frames, args) if isinstance(how, str) else how(frames)
        for key, how in aggregations.items()
    }
    if output is not None:
        entry = spark.createDataFrame(
            [(sorted(frames), skipped)], "frame_names array<string>, skipped array<string>"
        )
        stamped = entry.select(F.current_timestamp().alias("baked_at"), "frame_names", "skipped")
        for key, df in [("_catalog", stamped), *results.items()]:
            df.write.mode("overwrite").parquet(f"{output}/{key}")
    return results
