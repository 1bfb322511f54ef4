"""Report tables computed from the stored snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from hearthline.operators import demography, flows, history, quality, stats
from hearthline.sources.snapshots import FrameMap


def quality_kpis(f: FrameMap) -> FrameMap:
    """Inventory, duplicates, coverage and blanks."""
    out = {
        "files": quality.snapshot_inventory(f),
        "programme_rows": quality.programme_rows(f["raw_programmes"]),
        "qc_menage_fields": quality.qc_blank_fields(f["raw_menage"]),
        "qc_menages_no_score": quality.row_count(
            quality.households_without_score(f["raw_menage"], f["master_events"])
        ),
        "qc_summary": f["qc_summary"],
    }
    if "raw_scores" in f:
        out |= {
            "qc_dupes": quality.qc_dupes(f["raw_scores"], f["raw_menage"]),
            "score_period": quality.score_period(f["raw_scores"]),
            "qc_aberrant": quality.qc_aberrant(f["raw_scores"], f["master_events"]),
            "volume_kpis": quality.volume_kpis(
                f["raw_scores"], f["raw_menage"], f["delta_frame"], f["master_events"]
            ),
        }
    return out


def population_kpis(f: FrameMap) -> FrameMap:
    """Households by attribute, programme and status."""
    homes, events, paths = f["raw_menage"], f["master_events"], f["menage_trajectory"]
    sizes = demography.household_size(homes)
    by_programme = stats.households_by_programme(events)
    return {
        "milieu": demography.households_by(homes, "milieu"),
        "genre": demography.households_by(homes, "genre_cm"),
        "matrimonial": demography.households_by(homes, "etat_matrimonial_cm"),
        "region_dem": demography.households_by(homes, "region", ascending=True),
        "type_menage": demography.households_by(homes, "type_menage"),
        "taille": sizes,
        "top_provinces": demography.top_provinces(homes),
        "demog_mode_share": demography.demog_mode_share(homes),
        "mean_household_size": demography.mean_household_size(homes),
        "region_coverage": demography.region_coverage(homes),
        "prog_menages": by_programme,
        "n_non_classifie": stats.unclassified_households(events),
        "coverage_ratios": quality.coverage_ratios(
            quality.programme_rows(f["raw_programmes"]), by_programme
        ),
        "n_radiated": history.radiated_households(paths),
        "traj_status": history.trajectory_status(paths),
    }


def score_kpis(f: FrameMap) -> FrameMap:
    """Scores, eligibility and their series."""
    events = f["master_events"]
    weekly = stats.score_ts_weekly(f["score_timeseries"])
    near = f["near_threshold_timeseries"]
    return {
        "score_stats": stats.score_stats(events),
        "score_hist": stats.score_hist(events),
        "near_counts": stats.near_counts(events),
        "eligibility_global": stats.eligibility_global(events),
        "elig_by_prog": stats.eligibility_by(events, ["programme"]),
        "elig_by_region": stats.eligibility_by(events, ["region"], "region"),
        "elig_by_milieu": stats.eligibility_by(events, ["programme", "milieu"], "milieu"),
        "type_demande": stats.request_types(events),
        "score_ts_overall": weekly,
        "score_trend": stats.score_trend(weekly),
        "score_band": stats.score_band(weekly),
        **{f"score_ts_by_{d}": stats.score_ts_by(events, d) for d in ("region", "milieu", "genre_cm")},
        "near_threshold_ts": near.orderBy("week", "programme"),
        "near_latest": stats.near_latest(near),
        "near_share": stats.near_share(near),
    }


def change_kpis(f: FrameMap) -> FrameMap:
    """Score changes, volatility and churn."""
    delta = f["delta_frame"]
    regions = stats.volatility_region(delta)
    volatility, absolute = stats.weekly_volatility(delta), stats.weekly_abs_delta(delta)
    adjusted = stats.adjusted_profile(delta, [])
    return {
        "delta_global": stats.delta_global(delta),
        "vol_prog": stats.volatility_programme(delta),
        "vol_reg": regions,
        "vol_heatmap": stats.volatility_heatmap(regions),
        "delta_box": stats.delta_box(delta),
        "dd_global": adjusted,
        "dd_coverage": stats.adj_delta_coverage(adjusted),
        "dd_by_programme": stats.adj_delta_programme(delta),
        "dd_by_milieu": stats.adj_delta_by(delta, "milieu"),
        "dd_by_genre": stats.adj_delta_by(delta, "genre_cm"),
        "dd_days_dist": stats.gap_buckets(delta),
        "dd_scatter_sample": stats.delta_sample(delta),
        "dd_timeseries": stats.adj_delta_monthly(delta),
        "status_counts": stats.status_counts(delta),
        "status_by_region": stats.status_by_region(delta),
        "churn_prog": stats.churn_by(delta, ["programme"]),
        "churn_reg": stats.churn_by(delta, ["programme", "region"], ["AMOT", "ASD"]),
        "delta_vol_weekly": volatility,
        "delta_abs_weekly": absolute,
        "weekly_joined": stats.weekly_joined(volatility, absolute),
        "weekly_vol_kpis": stats.weekly_vol_kpis(volatility, absolute),
    }


def flow_kpis(f: FrameMap) -> FrameMap:
    """Monthly flows, re-entries and beneficiary records."""
    out = {
        "monthly_eligibility_flows": f["monthly_eligibility_flows"].orderBy("date"),
        "churn_timeline": f["churn_timeline"].orderBy("date"),
        "churn_table": flows.churn_table(f["churn_timeline"]),
        "reentry_summary": f["reentry_summary"],
        "reentry_buckets": flows.reentry_buckets(f["reentry_summary"]),
    }
    if "reentry_detail" in f:
        out["reentry_stats"] = flows.reentry_stats(f["reentry_detail"])
    if "raw_beneficiaire" in f:
        records = quality.beneficiary_stats(f["raw_beneficiaire"])
        out["beneficiaire_stats"] = records
        out["records_per_beneficiary"] = quality.records_per_beneficiary(records)
    if "monthly_beneficiaire_flows" in f:
        monthly = f["monthly_beneficiaire_flows"]
        out["monthly_beneficiaire_flows"] = monthly.orderBy("date")
        out["beneficiary_kpis"] = flows.beneficiary_kpis(monthly)
    return out


def build_kpis(frames: FrameMap) -> dict[str, DataFrame]:
    """All report tables for which the snapshots are present."""
    groups = (quality_kpis, population_kpis, score_kpis, change_kpis, flow_kpis)
    return reduce(lambda done, group: {**done, **group(frames)}, groups, {})
