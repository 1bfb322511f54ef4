"""Named frames: reading sources, writing and reading Parquet snapshots."""

from __future__ import annotations

from contextlib import suppress
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

FrameMap = dict[str, DataFrame]

#: Of stored tables; every Parquet reader knows it.
COMPRESSION = "zstd"


def load_frames(
    spark: SparkSession,
    sources: dict[str, Any],
    read_options: dict[str, dict[str, Any]] | None = None,
) -> FrameMap:
    """Frames from paths or ready frames; ``format`` in the options selects the reader."""
    frames: FrameMap = {}
    for name, source in sources.items():
        if isinstance(source, DataFrame):
            frames[name] = source
            continue
        options = dict((read_options or {}).get(name, {}))
        kind = options.pop("format", "csv" if str(source).endswith(".csv") else "parquet")
        if kind == "csv":
            options.setdefault("header", True)
        frames[name] = spark.read.format(kind).options(**options).load(source)
    return frames


def save_frames(
    frames: FrameMap, folder: str, overwrite: bool = True, skip_empty: bool = False
) -> dict[str, str]:
    """Write each frame to ``folder/name.parquet``; fail on an existing one unless overwriting."""
    mode = "overwrite" if overwrite else "errorifexists"
    written: dict[str, str] = {}
    for name, df in frames.items():
        if skip_empty and df.isEmpty():
            continue
        path = f"{folder}/{name}.parquet"
        df.write.mode(mode).option("compression", COMPRESSION).parquet(path)
        written[name] = path
    return written


def _statuses(spark: SparkSession, folder: str) -> list:
    """File-system entries of a folder, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"Snapshot folder not found: {folder}")
    return [(s.getPath().getName(), s.getModificationTime(), fs, s.getPath()) for s in fs.listStatus(path)]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete working data that a job made itself; nothing happens if it is absent."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    names = [entry[0] for entry in _statuses(spark, folder)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """Megabytes and last change per snapshot, from the file listing alone."""
    rows = [
        (
            name.removesuffix(".parquet"),
            round(fs.getContentSummary(path).getLength() / 1e6, 1),
            changed,
        )
        for name, changed, fs, path in _statuses(spark, folder)
        if name.endswith(".parquet")
    ]
    listed = spark.createDataFrame(rows, "fichier string, taille_mb double, changed long")
    return listed.select(
        "fichier", "taille_mb", F.timestamp_millis("changed").alias("mis_a_jour")
    )


def readable_snapshots(spark: SparkSession, folder: str) -> tuple[FrameMap, list[str]]:
    """Snapshots whose Parquet schema can be read, and the names of the others."""
    frames: FrameMap = {}
    names = _list_snapshots(spark, folder)
    for name in names:
        with suppress(PySparkException, Py4JJavaError):
            frames[name] = spark.read.parquet(f"{folder}/{name}.parquet")
    return frames, [n for n in names if n not in frames]


def load_snapshots(
    spark: SparkSession, folder: str, names: list[str] | None = None, strict: bool = False
) -> FrameMap:
    """The named snapshots, or the readable ones of a folder.

    A named snapshot must be there and readable; with ``strict`` all must.
    """
    frames, unreadable = readable_snapshots(spark, folder)
    wanted = [*frames, *unreadable] if names is None else names
    failed = sorted(n for n in wanted if n not in frames)
    if failed and (strict or names is not None):
        kind = ValueError if set(failed) <= set(unreadable) else FileNotFoundError
        raise kind(f"Snapshots absent or unreadable in {folder}: {', '.join(failed)}")
    return {n: frames[n] for n in wanted if n in frames}
