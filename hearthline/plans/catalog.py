"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.columns import round_to
from hearthline.functions.textrepair import repair_frame
from hearthline.operators import asof, demography, flows, history, master, quality, stats
from hearthline.operators.dedup import keep_one
from hearthline.plans import job
from hearthline.plans.calculations import run_aggregations, run_calculations
from hearthline.schema import (
    BENEFICIARY_TYPES,
    MAX_SCORE,
    PROGRAMMES,
    SCORE_TYPES,
)
from hearthline.session import configure, working_path
from hearthline.sources import csv, snapshots, tables

CUSTOM_BANDS = (0.05, 0.20, 1.0)
SEGMENTS = ("milieu", "region", "genre_cm")


class Registry:
    """Domain frames over one table folder; each is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @cached_property
    def households(self) -> DataFrame:
        return tables.households(self.spark, self.folder)

    @cached_property
    def scores(self) -> DataFrame:
        return tables.scores(self.spark, self.folder)

    @cached_property
    def programmes(self) -> DataFrame:
        return tables.programmes(self.spark, self.folder)

    @cached_property
    def beneficiaries(self) -> DataFrame:
        return tables.beneficiaries(self.spark, self.folder)

    @cached_property
    def events(self) -> DataFrame:
        """Events with programme and eligibility, without household attributes."""
        return master.build_master_events(self.scores, None, self.programmes)

    @cached_property
    def master(self) -> DataFrame:
        return master.build_master_events(self.scores, self.households, self.programmes)

    @cached_property
    def attributed_scores(self) -> DataFrame:
        """Events with household attributes, one row per score."""
        return master.join_households(self.scores, self.households)

    @cached_property
    def delta(self) -> DataFrame:
        """Score changes without household attributes."""
        return history.build_delta_frame(self.events)

    @cached_property
    def full_delta(self) -> DataFrame:
        """Score changes with household attributes, joined after the changes are found."""
        return master.join_households(self.delta, self.households)

    @cached_property
    def trajectory(self) -> DataFrame:
        return history.build_household_trajectory(self.events)

    @cached_property
    def reentries(self) -> DataFrame:
        return flows.build_reentry_detail(self.events)

    @cached_property
    def churn(self) -> DataFrame:
        return flows.build_churn_timeline(self.events)

    @cached_property
    def near(self) -> DataFrame:
        return asof.build_near_threshold_timeseries(self.events)

    @cached_property
    def score_series(self) -> DataFrame:
        return asof.build_score_timeseries(self.scores)

    @cached_property
    def weekly(self) -> DataFrame:
        return stats.score_ts_weekly(self.score_series)

    def stored_csv(self, df: DataFrame, label: str, order: str | None = None, **options: object) -> str:
        """Write a frame as CSV files whose name order is the row order."""
        path = working_path(self.spark, label)
        if order is not None:
            df = df.repartitionByRange(order).sortWithinPartitions(order).drop(order)
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        texts.write.options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', **options
        ).csv(path)
        return path


# --- sources and cleaning ---------------------------------------------------


def _untidy_scores(r: Registry) -> DataFrame:
    key = F.col("score_id_ano")
    text = {c: F.col(c).cast("string") for c in SCORE_TYPES}
    return tables.score_rows(r.spark, r.folder).select(
        F.when(key % 7 == 0, F.concat(text["menage_ano"], F.lit(".0")))
        .otherwise(text["menage_ano"])
        .alias("menage_ano"),
        text["score_id_ano"].alias("score_id_ano"),
        F.concat(F.lit(" "), "type_demande").alias("type_demande"),
        text["score_corrige"].alias("score_corrige"),
        F.when(key % 13 == 0, F.lit("n/a")).otherwise(text["score_calcule"]).alias("score_calcule"),
        F.when(key % 17 == 0, F.lit("inconnue"))
        .otherwise(text["date_calcul"])
        .alias("date_calcul"),
    )


def load_csv_coerced(r: Registry) -> DataFrame:
    path = r.stored_csv(_untidy_scores(r), "scores-untidy")
    return csv.load_csv(r.spark, path, SCORE_TYPES).select(*SCORE_TYPES)


def coerce_types(r: Registry) -> DataFrame:
    key = F.col("o_orderkey")
    number = (
        F.when(key % 4 == 0, key.cast("string"))
        .when(key % 4 == 1, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 4 == 2, F.concat(key.cast("string"), F.lit(".5")))
        .otherwise(F.lit("abc"))
    )
    flag = (
        F.when(key % 3 == 0, F.lit("True")).when(key % 3 == 1, F.lit("False")).otherwise(F.lit("?"))
    )
    texts = r.table("orders").select(
        key.alias("id"),
        number.alias("n"),
        number.alias("x"),
        flag.alias("b"),
        F.when(key % 5 == 0, F.lit("2024-13-45"))
        .otherwise(F.col("o_orderdate").cast("string"))
        .alias("d"),
    )
    typed = csv.coerce_types(texts, {"n": "long", "x": "double", "b": "boolean", "d": "timestamp"})
    # shown as text, as engines differ in how they hand out missing integers and flags
    return typed.withColumns({c: F.col(c).cast("string") for c in ("n", "b")})


def load_households(r: Registry) -> DataFrame:
    key = F.col("menage_ano")
    gender = F.element_at(
        F.array(*[F.lit(v) for v in ("male", "FEMME", " Homme", "féminin", "m", "f", "2")]),
        (key % 7 + 1).cast("int"),
    )
    rows = r.households.withColumns(
        {
            "milieu": F.concat(F.lit(" "), F.lower("milieu"), F.lit(" ")),
            "genre_cm": gender,
            "line_no": key * 2,
        }
    )
    copies = rows.where(key % 25 == 0).withColumns(
        {"region": F.lit("COPIE"), "line_no": key * 2 + 1}
    )
    path = r.stored_csv(rows.unionByName(copies), "menage", "line_no")
    return csv.load_households(r.spark, path)


def load_scores(r: Registry) -> DataFrame:
    rows = tables.score_rows_with_copies(r.spark, r.folder)
    return csv.load_scores(r.spark, r.stored_csv(rows, "scores", "line_no"))


def merge_score_files(r: Registry) -> DataFrame:
    rows = tables.score_rows_with_copies(r.spark, r.folder)
    odd = F.col("line_no") % 2 == 1
    paths = [
        r.stored_csv(rows.where(~odd), "scores-a", "line_no"),
        r.stored_csv(rows.where(odd), "scores-b", "line_no"),
    ]
    return csv.merge_score_files(r.spark, paths, working_path(r.spark, "merged"))


def load_programme(r: Registry) -> DataFrame:
    listed = r.programmes.where(F.col("programme") == "AMOT").select("menage_ano")
    return csv.load_programme(r.spark, r.stored_csv(listed, "amot"), "amot")


def union_programmes(r: Registry) -> DataFrame:
    parts = [r.programmes.where(F.col("programme") == p) for p in PROGRAMMES]
    return csv.union_programmes([*parts, parts[0]])


def load_beneficiaries(r: Registry) -> DataFrame:
    rows = r.beneficiaries.withColumn("partner_id", F.lower("partner_id"))
    return csv.load_beneficiaries(r.spark, r.stored_csv(rows, "beneficiaire")).select(
        *BENEFICIARY_TYPES
    )


def load_csv_quoted(r: Registry) -> DataFrame:
    """Reasons with quotation marks and commas in them."""
    said = F.concat(F.lit('dit "'), "motif", F.lit('", puis non'))
    path = r.stored_csv(r.beneficiaries.withColumn("motif", said), "quoted")
    return csv.load_beneficiaries(r.spark, path).select(*BENEFICIARY_TYPES)


def load_csv_mixed_headers(r: Registry) -> DataFrame:
    """Two score files, one with its columns in another order and without the correction."""
    rows = tables.score_rows(r.spark, r.folder)
    odd = F.col("score_id_ano") % 2 == 1
    turned = [c for c in reversed(SCORE_TYPES) if c != "score_corrige"]
    paths = [
        r.stored_csv(rows.where(~odd), "scores-plain"),
        r.stored_csv(rows.where(odd).select(*turned), "scores-turned"),
    ]
    return csv.load_csv(r.spark, paths, SCORE_TYPES).select(*SCORE_TYPES)


def load_csv_utf8(r: Registry) -> DataFrame:
    """Whole texts in UTF-8, without a mark that would tell the encoding."""
    flat = F.regexp_replace("text", "[\\r\\n]+", " ")
    path = r.stored_csv(r.table("documents").select("doc_id", flat.alias("text")), "utf8")
    return csv.load_csv(r.spark, path, {"doc_id": "long"}).select("doc_id", F.md5("text").alias("digest"))


def load_csv_line_breaks(r: Registry) -> DataFrame:
    """Whole texts with their line breaks, quoted."""
    rows = r.table("documents").select("doc_id", "text")
    path = r.stored_csv(rows, "line-breaks", quoteAll=True)
    loaded = csv.load_csv(r.spark, path, {"doc_id": "long"}, multi_line=True)
    return loaded.select("doc_id", F.md5("text").alias("digest"))


def load_csv_stray_quotes(r: Registry) -> DataFrame:
    """Unquoted reasons that end with, begin behind or are full of quotes, in front of empty fields."""
    key = F.col("menage_ano") % 4
    said = (
        F.when(key == 0, F.concat(F.lit('dit "'), "motif", F.lit('"')))
        .when(key == 1, F.concat("motif", F.lit('"')))
        .when(key == 2, F.concat(F.lit('5" de "'), "motif"))
        .otherwise(F.col("motif"))
    )
    rows = r.beneficiaries.withColumns({"motif": said, "actif": F.lit(None).cast("boolean")})
    kept = ["menage_ano", "partner_id", "date_insert", "motif", "actif"]
    # Written as plain lines: a CSV writer would quote these fields.
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept])
    path = working_path(r.spark, "stray")
    heads = r.spark.range(1).select(F.lit(",".join(kept)).alias("value"))
    for part in range(3):
        own = rows.where(F.col("menage_ano") % 3 == part).select(line.alias("value"))
        heads.unionByName(own).coalesce(1).write.mode("append").text(path)
    return csv.load_csv(r.spark, path, BENEFICIARY_TYPES).select("menage_ano", "partner_id", "date_insert", "motif", "actif")


def load_csv_missing_words(r: Registry) -> DataFrame:
    """Reasons of which some are words for a missing value."""
    words = F.array(*[F.lit(w) for w in ("NULL", "N/A", "NaN", "None", "nan")])
    missing = F.element_at(words, (F.col("menage_ano") % 5 + 1).cast("int"))
    motif = F.when(F.col("menage_ano") % 3 == 0, missing).otherwise(F.col("motif"))
    path = r.stored_csv(r.beneficiaries.withColumn("motif", motif), "missing")
    return csv.load_beneficiaries(r.spark, path).select(*BENEFICIARY_TYPES)


def parquet_scores(r: Registry) -> DataFrame:
    """Scores that are stored as Parquet reach the job as they are."""
    path = working_path(r.spark, "scores") + ".parquet"
    tables.score_rows(r.spark, r.folder).write.parquet(path)
    return job.read_scores(r.spark, [path], MAX_SCORE, working_path(r.spark, "scores-work"))[1]


def job_snapshots(r: Registry) -> DataFrame:
    """Rows of snapshots that the whole job writes from CSV files."""
    sources = job.Sources(
        scores=[r.stored_csv(tables.score_rows(r.spark, r.folder), "job-scores")],
        households=r.stored_csv(r.households, "job-menage"),
        programmes=r.stored_csv(r.programmes, "job-programmes"),
        beneficiaries=r.stored_csv(r.beneficiaries, "job-benef"),
    )
    frames = job.run_job(r.spark, sources, working_path(r.spark, "job"), profile="dashboard")
    names = ["raw_menage", "raw_programmes", "raw_beneficiaire", "master_events", "delta_frame", "churn_timeline"]
    counted = [frames[n].agg(F.count("*").alias("lignes")).select(F.lit(n).alias("fichier"), "lignes") for n in names]
    return reduce(DataFrame.unionByName, counted)


def frame_map_load(r: Registry) -> DataFrame:
    frames = snapshots.load_frames(
        r.spark, {"orders": f"{r.folder}/orders.parquet", "menage": r.households}
    )
    return (
        frames["orders"]
        .join(frames["menage"], F.col("o_custkey") == F.col("menage_ano"))
        .groupBy("milieu")
        .agg(F.count("*").alias("n_events"))
    )


def snapshot_roundtrip(r: Registry) -> DataFrame:
    folder = working_path(r.spark, "snapshots")
    snapshots.save_frames({"master_events": r.master, "raw_programmes": r.programmes}, folder)
    stored = snapshots.load_snapshots(r.spark, folder, ["master_events"])
    return stats.eligibility_by(stored["master_events"], ["programme", "milieu"])


def dedup_keep_first(r: Registry) -> DataFrame:
    rows = csv.score_postprocess(tables.score_rows_with_copies(r.spark, r.folder))
    return csv.dedup_scores(rows, F.col("line_no"))


def dedup_subset(r: Registry) -> DataFrame:
    rows = csv.score_postprocess(tables.score_rows_with_copies(r.spark, r.folder))
    twice = rows.unionByName(rows.withColumn("line_no", F.col("line_no") + 1_000_000_000))
    return csv.dedup_scores(twice.drop("score_id_ano"), F.col("line_no"))


def dedup_keep_latest(r: Registry) -> DataFrame:
    rows = csv.score_postprocess(tables.score_rows_with_copies(r.spark, r.folder))
    return csv.keep_latest_scores(rows).drop("line_no")


def repair_text(r: Registry) -> DataFrame:
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    texts = r.table("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, damaged).otherwise(F.col("text")).alias("text"),
    )
    fixed = repair_frame(texts)
    return fixed.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# --- events for daily series ------------------------------------------------


def dense_events(r: Registry) -> DataFrame:
    """Sub-second events of the events table as score events."""
    kind = F.col("event_type")
    return r.table("events").select(
        F.col("user_id").alias("menage_ano"),
        F.col("event_id").alias("score_id_ano"),
        F.col("ts").alias("date_calcul"),
        F.sqrt(F.abs("value")).alias("score_final"),
        F.when(kind == "error", F.lit("radiation"))
        .when(kind == "view", F.lit("inscription"))
        .otherwise(kind)
        .alias("type_demande"),
    )


def timeseries_seed(r: Registry) -> DataFrame:
    states = asof.household_states(r.scores)
    return states.select(
        "menage_ano",
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("stop").cast("timestamp_ntz").alias("stop"),
        F.col("v").alias("score"),
    )


def pivot_scores_mean(r: Registry) -> DataFrame:
    wide = master.build_pivot_wide(r.events, how="mean")
    cells = [c for c in wide.columns if c.startswith("score_")]
    return wide.withColumns({c: round_to(F.col(f"`{c}`"), 6) for c in cells})


# --- quality ----------------------------------------------------------------


def qc_summary(r: Registry) -> DataFrame:
    raw = csv.final_score(tables.score_rows_with_copies(r.spark, r.folder))
    clean = csv.dedup_scores(
        csv.score_postprocess(tables.score_rows_with_copies(r.spark, r.folder)), F.col("line_no")
    )
    rows = r.households
    raw_households = rows.unionByName(rows.where(F.col("menage_ano") % 25 == 0))
    households = keep_one(raw_households, ["menage_ano"], [F.col("menage_ano").asc()])
    events = master.build_master_events(clean, None, r.programmes)
    return quality.qc_metrics(raw, clean, raw_households, households, events)


def qc_dupes(r: Registry) -> DataFrame:
    rows = tables.score_rows_with_copies(r.spark, r.folder)
    homes = r.households.select("menage_ano")
    return quality.qc_dupes(rows, homes.unionByName(homes.where(F.col("menage_ano") % 25 == 0)))


def snapshot_inventory(r: Registry) -> DataFrame:
    frames = {
        "raw_menage": r.households,
        "raw_scores": r.scores,
        "raw_programmes": r.programmes,
        "master_events": r.events,
        "delta_frame": r.delta,
        "menage_timeline": history.build_household_timeline(r.events),
        "menage_trajectory": history.build_household_trajectory(r.events, status=False),
        **{f"programme_{p}": master.build_programme_frame(r.events, p) for p in PROGRAMMES},
    }
    return quality.snapshot_inventory(frames)


# --- user calculations ------------------------------------------------------


def calculations_chain(r: Registry) -> DataFrame:
    frames = run_calculations(
        {"master": r.events},
        {
            "latest": lambda f: history.household_latest(f["master"]),
            "summary": lambda f: f["latest"]
            .groupBy("programme")
            .agg(
                F.count("*").alias("n_menages"),
                round_to(F.avg("score_final_corrige"), 4).alias("score_moyen"),
            ),
        },
    )
    return frames["summary"]


def kpi_callable(r: Registry) -> DataFrame:
    baked = run_aggregations(
        r.spark, {"types": lambda f: stats.request_types(f["master"])}, frames={"master": r.events}
    )
    return baked["types"]


def kpi_sql(r: Registry) -> DataFrame:
    text = """
        SELECT programme, count(*) AS n_events, count(DISTINCT menage_ano) AS n_menages
        FROM {master} WHERE score_final <= :limit GROUP BY programme
    """
    baked = run_aggregations(
        r.spark, {"kpi": text}, frames={"master": r.events}, args={"limit": 12.0}
    )
    return baked["kpi"]


_ID = ["menage_ano", "date_calcul", "score_id_ano", "programme"]
_DELTA = [
    *_ID,
    "score_avant",
    "score_apres",
    "date_avant",
    "delta_ISE",
    "abs_delta",
    "days_between",
    "side_avant",
    "side_apres",
    "status_change",
]

BUILDERS: dict[str, Callable[[Registry], DataFrame]] = {
    # sources, cleaning, sinks
    "load_csv_coerced": load_csv_coerced,
    "coerce_types": coerce_types,
    "load_csv_quoted": load_csv_quoted,
    "load_csv_mixed_headers": load_csv_mixed_headers,
    "load_csv_utf8": load_csv_utf8,
    "load_csv_line_breaks": load_csv_line_breaks,
    "load_csv_missing_words": load_csv_missing_words,
    "load_csv_stray_quotes": load_csv_stray_quotes,
    "parquet_scores": parquet_scores,
    "job_snapshots": job_snapshots,
    "load_households": load_households,
    "load_scores": load_scores,
    "score_postprocess": lambda r: r.scores,
    "merge_score_files": merge_score_files,
    "load_programme": load_programme,
    "union_programmes": union_programmes,
    "load_beneficiaries": load_beneficiaries,
    "frame_map_load": frame_map_load,
    "snapshot_roundtrip": snapshot_roundtrip,
    "dedup_keep_first": dedup_keep_first,
    "dedup_subset": dedup_subset,
    "dedup_keep_latest": dedup_keep_latest,
    "repair_text": repair_text,
    # derived frames
    "master_events": lambda r: r.master,
    "household_timeline": lambda r: history.build_household_timeline(r.events),
    "score_deltas": lambda r: r.delta.select(
        *_DELTA, round_to(F.col("delta_distribue"), 6).alias("delta_distribue")
    ),
    "programme_frame": lambda r: master.build_programme_frame(r.master, "amot"),
    "events_with_benef": lambda r: master.build_beneficiary_events(
        r.events.select(*_ID, "score_final", "eligible"), r.beneficiaries
    ),
    "pivot_scores": lambda r: master.build_pivot_wide(r.events),
    "pivot_scores_mean": pivot_scores_mean,
    "volatility_summary": lambda r: stats.build_volatility_summary(
        r.full_delta, ["programme", "region"]
    ).select(
        "programme",
        "region",
        "n",
        *stats.rounded({c: c for c in ("mean_delta", "sigma_delta", "p25", "median", "p75", "p90_abs")}, 6),
    ),
    "eligibility_churn": lambda r: stats.build_eligibility_churn(
        r.full_delta, ["programme", "milieu"]
    ).withColumn("churn_eligibilite", round_to(F.col("churn_eligibilite"), 6)),
    "household_trajectory": lambda r: r.trajectory,
    "score_timeseries": lambda r: r.score_series,
    "score_timeseries_parts": lambda r: asof.build_score_timeseries(r.scores, crowded=8),
    "score_timeseries_daily": lambda r: asof.build_score_timeseries(dense_events(r), freq="D"),
    "timeseries_seed": timeseries_seed,
    "score_timeseries_dims": lambda r: asof.build_score_timeseries(
        r.attributed_scores, segments=SEGMENTS
    ),
    "monthly_flows": lambda r: flows.build_monthly_eligibility_flows(r.events),
    "beneficiary_flows": lambda r: flows.build_monthly_beneficiary_flows(r.beneficiaries),
    "churn_timeline": lambda r: r.churn.withColumns(
        {c: round_to(F.col(c), 6) for c in ("churn_rate", "acquisition_rate", "net_rate")}
    ),
    "reentry_detail": lambda r: r.reentries,
    "reentry_summary": lambda r: flows.build_reentry_summary(r.reentries),
    "near_threshold_ts": lambda r: r.near.orderBy("week", "programme"),
    "near_threshold_custom": lambda r: asof.build_near_threshold_timeseries(
        r.events, bands=CUSTOM_BANDS
    ),
    # quality accounting
    "qc_summary": qc_summary,
    "qc_no_score": lambda r: quality.households_without_score(
        r.households.select("menage_ano").unionByName(tables.silent_households(r.spark, r.folder)), r.scores
    ).select("menage_ano"),
    "snapshot_inventory": snapshot_inventory,
    "programme_rows": lambda r: quality.programme_rows(r.programmes),
    "volume_kpis": lambda r: quality.volume_kpis(r.scores, r.households, r.delta, r.scores),
    "qc_dupes": qc_dupes,
    "score_period": lambda r: quality.score_period(r.scores),
    "qc_aberrant": lambda r: quality.qc_aberrant(
        tables.unfiltered_scores(r.spark, r.folder), r.events
    ),
    "qc_blank_fields": lambda r: quality.qc_blank_fields(r.households),
    # population and programmes
    "radiated_households": lambda r: history.radiated_households(r.trajectory),
    "trajectory_status": lambda r: history.trajectory_status(r.trajectory),
    "households_by_programme": lambda r: stats.households_by_programme(r.events),
    "unclassified_households": lambda r: stats.unclassified_households(r.events),
    "demog_milieu": lambda r: demography.households_by(r.households, "milieu"),
    "demog_genre": lambda r: demography.households_by(r.households, "genre_cm"),
    "demog_matrimonial": lambda r: demography.households_by(r.households, "etat_matrimonial_cm"),
    "demog_region": lambda r: demography.households_by(r.households, "region", ascending=True),
    "demog_type": lambda r: demography.households_by(r.households, "type_menage"),
    "household_size": lambda r: demography.household_size(r.households),
    "top_provinces": lambda r: demography.top_provinces(r.households),
    "demog_mode_share": lambda r: demography.demog_mode_share(r.households),
    "mean_household_size": lambda r: demography.mean_household_size(r.households),
    "region_coverage": lambda r: demography.region_coverage(r.households),
    # scores and eligibility
    "score_stats": lambda r: stats.score_stats(r.events),
    "score_hist": lambda r: stats.score_hist(r.events),
    "near_counts": lambda r: stats.near_counts(r.events),
    "eligibility_global": lambda r: stats.eligibility_global(r.events),
    "elig_by_programme": lambda r: stats.eligibility_by(r.events, ["programme"]).orderBy("programme"),
    "elig_by_region": lambda r: stats.eligibility_by(r.master, ["region"], "region")
    .select("region", "pct_eligible")
    .orderBy("pct_eligible", "region"),
    "elig_by_milieu": lambda r: stats.eligibility_by(r.master, ["programme", "milieu"], "milieu")
    .select("programme", "milieu", "pct_eligible")
    .orderBy("programme", "milieu"),
    "request_types": lambda r: stats.request_types(r.events),
    # score changes
    "delta_global": lambda r: stats.delta_global(r.delta),
    "volatility_programme": lambda r: stats.volatility_programme(r.delta),
    "volatility_region": lambda r: stats.volatility_region(r.full_delta),
    "volatility_heatmap": lambda r: stats.volatility_heatmap(
        stats.volatility_region(r.full_delta)
    ),
    "delta_box": lambda r: stats.delta_box(r.delta),
    "adj_delta_global": lambda r: stats.adjusted_profile(r.delta, []),
    "adj_delta_programme": lambda r: stats.adj_delta_programme(r.delta),
    "adj_delta_milieu": lambda r: stats.adj_delta_by(r.full_delta, "milieu"),
    "adj_delta_genre": lambda r: stats.adj_delta_by(r.full_delta, "genre_cm"),
    "gap_buckets": lambda r: stats.gap_buckets(r.delta),
    "delta_sample": lambda r: stats.delta_sample(r.delta).withColumn(
        "delta_distribue", round_to(F.col("delta_distribue"), 6)
    ),
    "adj_delta_monthly": lambda r: stats.adj_delta_monthly(r.delta),
    "adj_delta_coverage": lambda r: stats.adj_delta_coverage(stats.adjusted_profile(r.delta, [])),
    "status_counts": lambda r: stats.status_counts(r.delta),
    "status_by_region": lambda r: stats.status_by_region(r.full_delta),
    "churn_programme": lambda r: stats.churn_by(r.delta, ["programme"]),
    "churn_region": lambda r: stats.churn_by(
        r.full_delta, ["programme", "region"], ["AMOT", "ASD"]
    ),
    # weekly series
    "weekly_volatility": lambda r: stats.weekly_volatility(r.delta),
    "weekly_abs_delta": lambda r: stats.weekly_abs_delta(r.delta),
    "weekly_joined": lambda r: stats.weekly_joined(
        stats.weekly_volatility(r.delta), stats.weekly_abs_delta(r.delta)
    ),
    "weekly_vol_kpis": lambda r: stats.weekly_vol_kpis(
        stats.weekly_volatility(r.delta), stats.weekly_abs_delta(r.delta), "1997-01-01", "2000-12-31"
    ),
    "score_ts_weekly": lambda r: r.weekly,
    "score_ts_region": lambda r: stats.score_ts_by(r.master, "region"),
    "score_ts_milieu": lambda r: stats.score_ts_by(r.master, "milieu"),
    "score_ts_segment": lambda r: stats.score_ts_by(r.master, "milieu", ["Urbain"]),
    "score_ts_genre": lambda r: stats.score_ts_by(r.master, "genre_cm"),
    "score_trend": lambda r: stats.score_trend(r.weekly),
    "score_band": lambda r: stats.score_band(r.weekly),
    "near_latest": lambda r: stats.near_latest(r.near),
    "near_share": lambda r: stats.near_share(r.near),
    # flows
    "beneficiary_stats": lambda r: quality.beneficiary_stats(r.beneficiaries),
    "beneficiary_kpis": lambda r: flows.beneficiary_kpis(
        flows.build_monthly_beneficiary_flows(r.beneficiaries)
    ),
    "reentry_stats": lambda r: flows.reentry_stats(r.reentries),
    "reentry_buckets": lambda r: flows.reentry_buckets(flows.build_reentry_summary(r.reentries)),
    "churn_table": lambda r: flows.churn_table(r.churn, ["AMOT", "ASD"]),
    "coverage_ratios": lambda r: quality.coverage_ratios(
        quality.programme_rows(r.programmes), stats.households_by_programme(r.events)
    ),
    "records_per_beneficiary": lambda r: quality.records_per_beneficiary(
        quality.beneficiary_stats(r.beneficiaries)
    ),
    # household explorer
    "household_history": lambda r: history.household_history(r.master),
    "household_profile": lambda r: history.household_profile(r.households),
    "household_latest": lambda r: history.household_latest(r.events),
    "household_drift": lambda r: history.household_drift(r.events),
    "household_events_labelled": lambda r: history.label_events(
        history.household_history(r.master)
    ),
    # user calculations
    "calculations_chain": calculations_chain,
    "kpi_callable": kpi_callable,
    "kpi_sql": kpi_sql,
}


def build(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Plan of one named query."""
    return BUILDERS[name](Registry(spark, folder))
