"""The job end to end on small files, and its command line."""

import pytest

from hearthline.plans.job import Sources, parse_arguments, run_job, run_kpis
from hearthline.sources import tables

FOLDER = "/root/testdata/sf0.001"

BOTH = {
    "raw_menage", "raw_programmes", "raw_beneficiaire", "master_events", "delta_frame",
    "menage_timeline", "menage_trajectory", "score_timeseries", "near_threshold_timeseries",
    "monthly_eligibility_flows", "churn_timeline", "reentry_summary", "qc_summary",
    "programme_AMOT", "programme_ASD", "programme_AMOA",
}
FULL = BOTH | {
    "raw_scores", "reentry_detail", "pivot_wide", "beneficiaire_enriched_events",
    "monthly_beneficiaire_flows",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    frames = {
        "scores": tables.score_rows(spark, FOLDER),
        "menage": tables.households(spark, FOLDER),
        "programmes": tables.programmes(spark, FOLDER),
        "beneficiaire": tables.beneficiaries(spark, FOLDER),
    }
    for name, df in frames.items():
        df.write.option("header", True).csv(f"{root}/{name}")
    return Sources(
        scores=[f"{root}/scores"],
        households=f"{root}/menage",
        programmes=f"{root}/programmes",
        beneficiaries=f"{root}/beneficiaire",
    )


def test_full_profile_and_kpis(spark, files, tmp_path):
    frames = run_job(spark, files, str(tmp_path / "snap"), profile="full")
    assert set(frames) == FULL
    assert {r["milieu"] for r in frames["score_timeseries"].select("milieu").distinct().collect()} == {
        None, "Urbain", "Rural",
    }
    kpis = run_kpis(spark, str(tmp_path / "snap"), str(tmp_path / "kpi"))
    assert len(kpis) > 60
    assert kpis["elig_by_prog"].count() == 4
    rows = {r["fichier"]: r for r in kpis["files"].collect()}
    assert rows["master_events"]["lignes"] == frames["master_events"].count()
    assert rows["master_events"]["mis_a_jour"] is not None
    (records,) = kpis["beneficiaire_stats"].collect()
    assert records["size_mb"] == rows["raw_beneficiaire"]["taille_mb"] is not None


def test_dashboard_profile_daily_has_fewer_snapshots(spark, files, tmp_path):
    frames = run_job(spark, files, str(tmp_path / "snap"), profile="dashboard", freq="D")
    assert set(frames) == BOTH
    assert frames["score_timeseries"].where("milieu IS NOT NULL").isEmpty()
    assert frames["score_timeseries"].count() > 2000


def test_only_scores_given(spark, files, tmp_path):
    frames = run_job(spark, Sources(scores=files.scores), str(tmp_path / "snap"), profile="dashboard")
    names = {r[0] for r in frames["master_events"].select("programme").distinct().collect()}
    assert names == {"NON CLASSIFIE"}


def test_missing_scores_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="scores"):
        run_job(spark, Sources(scores=[]), str(tmp_path))


def test_command_line():
    args = parse_arguments(["--scores", "a.csv", "--output", "o"])
    assert (args.snapshot_profile, args.timeseries_freq) == ("dashboard", "weekly")
    args = parse_arguments(
        ["--scores", "a.csv", "b.csv", "--output", "o", "--timeseries-freq", "daily",
         "--snapshot-profile", "full", "--programme", "AMOT=x.csv"]
    )
    assert args.scores == ["a.csv", "b.csv"]
    assert (args.snapshot_profile, args.timeseries_freq) == ("full", "daily")


def test_rejected_records_are_stored_and_counted(spark, tmp_path):
    header = "menage_ano,score_id_ano,type_demande,score_corrige,score_calcule,date_calcul\n"
    (tmp_path / "s.csv").write_text(
        header + '1,10,"ins\ncription",,5.0,2025-01-01\n2,20,a,,6.0,2025-01-01\n3,30,a,,6.0,2025-01-01,trop\n'
    )
    for multi_line, rejected, kept in ((False, 3, 1), (True, 1, 2)):
        sources = Sources(scores=[str(tmp_path / "s.csv")], multi_line=multi_line)
        frames = run_job(spark, sources, str(tmp_path / f"snap{multi_line}"), profile="full")
        assert frames["raw_scores"].count() == kept
        assert {r["source"] for r in frames["rejected_lines"].collect()} == {"scores"}
        assert frames["rejected_lines"].count() == rejected
        lines = {r["metric"]: (r["before"], r["after"], r["dropped"]) for r in frames["qc_summary"].collect()}
        assert lines["scores_rejected_rows"] == lines["scores_raw_rows"] == (kept + rejected, kept, rejected)
    assert parse_arguments(["--scores", "a.csv", "--output", "o", "--multi-line"]).multi_line
