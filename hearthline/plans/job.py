"""The full job: raw files to snapshots, and snapshots to report tables.

Run with ``spark-submit -m`` style or ``python -m hearthline.plans.job --help``.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.columns import category_values
from hearthline.operators import asof, flows, history, master, quality
from hearthline.operators.asof import DAILY, SEGMENTS, WEEKLY
from hearthline.plans.kpis import build_kpis
from hearthline.schema import MAX_SCORE, PROGRAMME_TYPES, struct_of
from hearthline.session import configure
from hearthline.sources import csv
from hearthline.sources.snapshots import (
    COMPRESSION,
    FrameMap,
    load_snapshots,
    remove_folder,
    save_frames,
    snapshot_files,
)

PROFILES = ("dashboard", "full")


@dataclass
class Sources:
    """Where the raw files are; a path may be a folder or a glob.

    ``multi_line``: quoted fields of the CSV files may hold line breaks.
    """

    scores: list[str]
    households: str | None = None
    programmes: str | None = None
    programme_lists: dict[str, str] = field(default_factory=dict)
    beneficiaries: str | None = None
    multi_line: bool = False


class SnapshotWriter:
    """Writes frames and hands back the stored version.

    Later steps read the stored table, so they neither repeat the work before it
    nor depend on the executors that did it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.names: list[str] = []

    def store(self, name: str, df: DataFrame) -> DataFrame:
        path = save_frames({name: df}, self.folder)[name]
        self.names.append(name)
        return self.spark.read.parquet(path)


def csv_paths(paths: list[str]) -> list[str]:
    """Score files that are not Parquet."""
    return [p for p in paths if not p.rstrip("/").endswith(".parquet")]


def csv_sources(sources: Sources) -> dict[str, list[str]]:
    """The CSV files that the job reads, by the name of their source."""
    lists = list(sources.programme_lists.values())
    found = {
        "scores": csv_paths(sources.scores),
        "menage": [sources.households] if sources.households else [],
        "programmes": [sources.programmes] if sources.programmes else lists,
        "beneficiaire": [sources.beneficiaries] if sources.beneficiaries else [],
    }
    return {name: paths for name, paths in found.items() if paths}


class ParsedSources:
    """The CSV files of the job as stored text tables, each file parsed once.

    Raw rows, clean rows, rejected records and record counts are all read from
    these tables. Several score files stay apart, as each is cleaned by itself.
    """

    def __init__(self, spark: SparkSession, sources: Sources, work: SnapshotWriter):
        self.spark = spark
        self.tables = {
            name: [
                work.store(f"text_{name}_{i}", csv.parse(spark, path, multi_line=sources.multi_line))
                for i, path in enumerate(paths)
            ]
            for name, paths in csv_sources(sources).items()
        }

    def kept(self, name: str) -> list[DataFrame]:
        """Records of a source that could be read, by file."""
        return [csv.kept_records(t) for t in self.tables.get(name, [])]

    def rejected(self) -> DataFrame:
        """(source, path, line) of the records that could not be read."""
        parts = [
            csv.rejected_records(t).select(F.lit(name).alias("source"), "path", "line")
            for name, tables in self.tables.items()
            for t in tables
        ]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "source string, path string, line string"))

    def counts(self) -> dict[str, DataFrame]:
        """Physical records per source, rejected ones included."""
        return {
            name: reduce(DataFrame.unionByName, [t.select(csv.LINE) for t in tables]).groupBy().agg(F.count("*").alias("n"))
            for name, tables in self.tables.items()
        }


def read_scores(
    spark: SparkSession,
    paths: list[str],
    max_score: float,
    work: str,
    multi_line: bool = False,
    texts: list[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score rows as read, and cleaned; Parquet scores are taken as they are.

    With several files, or Parquet and CSV paths together, the latest version of
    an id counts. ``texts`` are the text tables of the CSV paths where these are
    parsed already; otherwise they are stored below ``work``.
    """
    if texts is None:
        aside = SnapshotWriter(spark, work)
        parsed = [csv.parse(spark, p, multi_line=multi_line) for p in csv_paths(paths)]
        texts = [csv.kept_records(aside.store(f"text_scores_{i}", t)) for i, t in enumerate(parsed)]
    stored = [p for p in paths if p not in csv_paths(paths)]
    parts = []
    if stored:
        ready = spark.read.parquet(*stored)
        parts.append((ready, ready))
    if texts:
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv.raw_scores_of(t).drop(csv.LINE) for t in texts])
        clean = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv.scores_of(t, max_score) for t in texts])
        parts.append((raw, clean if len(texts) == 1 else csv.keep_latest_scores(clean)))
    both = zip(*parts)
    raw, clean = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), p) for p in both)
    return raw, csv.keep_latest_scores(clean) if stored and texts else clean


def read_programmes(spark: SparkSession, sources: Sources, texts: list[DataFrame]) -> DataFrame:
    """Membership from the consolidated file, else from one list per programme."""
    if sources.programmes:
        return csv.programme_table_of(texts[0])
    if sources.programme_lists:
        lists = zip(sources.programme_lists, texts, strict=True)
        return csv.union_programmes([csv.programme_of(t, name) for name, t in lists])
    return spark.createDataFrame([], struct_of(PROGRAMME_TYPES))


def clustered(events: DataFrame) -> DataFrame:
    """Events laid out by household and date, so that a household lookup reads few files.

    The date is part of the range key: a household with very many events spans
    several files instead of one task.
    """
    return events.repartitionByRange("menage_ano", "date_calcul").sortWithinPartitions(
        "menage_ano", "programme", "date_calcul"
    )


def run_job(
    spark: SparkSession,
    sources: Sources,
    output: str,
    profile: str = "full",
    freq: str = WEEKLY,
    max_score: float = MAX_SCORE,
) -> FrameMap:
    """Build and store every snapshot of the profile; returns the stored frames."""
    if profile not in PROFILES:
        raise ValueError(f"Unknown profile: {profile}")
    if not sources.scores:
        raise ValueError("No path of a scores file was given")
    configure(spark)
    full = profile == "full"
    out = SnapshotWriter(spark, output)

    work = f"{output.rstrip('/')}/_work"
    aside = SnapshotWriter(spark, work)
    parsed = ParsedSources(spark, sources, aside)
    if sources.households:
        (raw_households,) = parsed.kept("menage")
        households = csv.households_of(raw_households)
    else:
        raw_households = households = csv.empty_households(spark)
    households = out.store("raw_menage", households)
    raw_scores, scores = read_scores(spark, sources.scores, max_score, work, texts=parsed.kept("scores"))
    # the light profile has no score snapshot, but the cleaned scores are still needed twice
    scores = (out if full else aside).store("raw_scores", scores)
    programmes = out.store("raw_programmes", read_programmes(spark, sources, parsed.kept("programmes")))
    beneficiaries = None
    if sources.beneficiaries:
        beneficiaries = out.store("raw_beneficiaire", csv.beneficiaries_of(parsed.kept("beneficiaire")[0]))

    # Always written, so that none of an earlier run stays; named only where there are any.
    rejected = out.store("rejected_lines", parsed.rejected())
    if rejected.isEmpty():
        out.names.remove("rejected_lines")

    events = master.build_master_events(scores, households, programmes, lay_out=clustered)
    events = out.store("master_events", events)

    # Looked for once, on a few columns, for score changes and trajectories.
    previous = aside.store("previous_events", history.previous_events(events))
    out.store("delta_frame", history.build_delta_frame(events, previous=previous))
    out.store("menage_timeline", history.build_household_timeline(events))
    out.store("menage_trajectory", history.build_household_trajectory(events, previous=previous))
    crowded = asof.crowding(events)
    out.store(
        "score_timeseries",
        asof.build_score_timeseries(events, freq, SEGMENTS if full else (), crowded=crowded),
    )
    out.store(
        "near_threshold_timeseries",
        asof.build_near_threshold_timeseries(events, freq=freq, crowded=crowded),
    )
    out.store("monthly_eligibility_flows", flows.build_monthly_eligibility_flows(events))
    out.store("churn_timeline", flows.build_churn_timeline(events))
    detail = flows.build_reentry_detail(events)
    if full:
        detail = out.store("reentry_detail", detail)
    out.store("reentry_summary", flows.build_reentry_summary(detail))
    out.store(
        "qc_summary",
        quality.qc_metrics(
            raw_scores, scores, raw_households, households, events, max_score,
            rejected, parsed.counts(),
        ),
    )
    # One pass over the events for all programmes; each becomes a snapshot of its own.
    names = category_values(programmes, "programme")
    if names:
        by_programme = f"{work}/by_programme"
        listed = events.where(F.col("programme").isin(*names)).withColumn("_part", F.col("programme"))
        listed.write.partitionBy("_part").mode("overwrite").option("compression", COMPRESSION).parquet(by_programme)
        parts = spark.read.schema(listed.schema).parquet(by_programme)
    for name in names:
        out.store(f"programme_{name}", master.build_programme_frame(parts.where(F.col("_part") == name).drop("_part"), name))
    if full:
        types = master.pivot_values(events)
        out.store("pivot_wide", master.build_pivot_wide(events, values=types))
        if beneficiaries is not None:
            out.store(
                "beneficiaire_enriched_events",
                master.build_beneficiary_events(events, beneficiaries),
            )
            out.store(
                "monthly_beneficiaire_flows",
                flows.build_monthly_beneficiary_flows(beneficiaries),
            )
    remove_folder(spark, work)
    return load_snapshots(spark, output, out.names)


def run_kpis(
    spark: SparkSession, snapshots: str, output: str, skip_unreadable: bool = False
) -> FrameMap:
    """Compute every report table from stored snapshots and store it.

    An unreadable snapshot is an error unless it may be skipped with its tables.
    """
    configure(spark)
    tables = build_kpis(load_snapshots(spark, snapshots, strict=not skip_unreadable))
    files = snapshot_files(spark, snapshots)
    tables["files"] = tables["files"].join(files, "fichier", "left")
    if "beneficiaire_stats" in tables:
        records = files.where(F.col("fichier") == "raw_beneficiaire").agg(F.max("taille_mb"))
        tables["beneficiaire_stats"] = tables["beneficiaire_stats"].withColumn("size_mb", records.scalar())
    save_frames(tables, output)
    return load_snapshots(spark, output, list(tables))


def parse_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line of the job."""
    parser = argparse.ArgumentParser(description="Registry files to Parquet snapshots and KPIs")
    parser.add_argument("--scores", nargs="+", required=True)
    parser.add_argument("--households")
    parser.add_argument("--programmes", help="consolidated file with a programme column")
    parser.add_argument(
        "--programme", action="append", default=[], metavar="NAME=PATH", help="one list"
    )
    parser.add_argument("--beneficiaries")
    parser.add_argument(
        "--multi-line", action="store_true", help="quoted fields may hold line breaks (files are not split)"
    )
    parser.add_argument("--output", required=True)
    parser.add_argument("--kpi-output")
    parser.add_argument("--snapshot-profile", choices=PROFILES, default="dashboard")
    parser.add_argument("--timeseries-freq", choices=["weekly", "daily"], default="weekly")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    """Entry point for spark-submit."""
    args = parse_arguments(argv)
    spark = SparkSession.builder.appName("registry-snapshots").getOrCreate()
    sources = Sources(
        scores=args.scores,
        households=args.households,
        programmes=args.programmes,
        programme_lists=dict(item.split("=", 1) for item in args.programme),
        beneficiaries=args.beneficiaries,
        multi_line=args.multi_line,
    )
    freq = DAILY if args.timeseries_freq == "daily" else WEEKLY
    frames = run_job(spark, sources, args.output, args.snapshot_profile, freq)
    print(f"Built {len(frames)} snapshots")
    if args.kpi_output:
        print(f"Built {len(run_kpis(spark, args.output, args.kpi_output))} tables")


if __name__ == "__main__":
    main()
