"""Fact table, deltas and histories on edge cases."""

import re

import numpy as np
import pytest
from helpers import day, events
from pyspark.sql import functions as F

from hearthline.operators import history, master, stats


def programmes(spark, rows):
    return spark.createDataFrame(rows, "menage_ano long, programme string")


def scores(spark, rows):
    return spark.createDataFrame(
        [(h, i, t, s, day(d)) for h, i, t, s, d in rows],
        "menage_ano long, score_id_ano long, type_demande string, score_final double, date_calcul timestamp_ntz",
    )


def test_master_fans_out_and_never_leaves_flags_null(spark):
    events_ = scores(spark, [(1, 1, "a", 9.0, "2025-01-01"), (2, 2, "a", 9.0, "2025-01-01"),
                             (3, 3, "a", None, "2025-01-01"), (4, 4, "a", 9.0, None)])
    homes = spark.createDataFrame(
        [(1, "Urbain", "x"), (3, "Rural", "y")], "menage_ano long, milieu string, type_demande string"
    )
    frame = master.build_master_events(
        events_, homes, programmes(spark, [(1, "amot"), (1, "ASD"), (3, "AMOT"), (4, "AMOA")])
    )
    rows = {(r["menage_ano"], r["programme"]): r for r in frame.collect()}
    assert set(rows) == {(1, "AMOT"), (1, "ASD"), (2, "NON CLASSIFIE"), (3, "AMOT"), (4, "AMOA")}
    assert rows[(1, "AMOT")]["eligible"] and not rows[(1, "AMOT")]["near_0.25"]
    assert rows[(1, "AMOT")]["near_0.50"]
    for key in ((2, "NON CLASSIFIE"), (3, "AMOT"), (4, "AMOA")):
        assert rows[key]["eligible"] is False and rows[key]["near_0.10"] is False
    assert rows[(1, "ASD")]["type_demande_menage"] == "x"
    assert rows[(2, "NON CLASSIFIE")]["milieu"] is None


def test_null_household_matches_null_household(spark):
    events_ = scores(spark, [(None, 1, "a", 9.0, "2025-01-01")])
    homes = spark.createDataFrame([(None, "Rural")], "menage_ano long, milieu string")
    assert master.build_master_events(events_, homes).collect()[0]["milieu"] == "Rural"


def test_score_on_the_threshold_is_not_eligible(spark):
    frame = master.add_threshold_flags(events(spark, [(1, "ASD", "2025-01-01", 1, "a", 9.743001)]))
    row = frame.collect()[0]
    assert not row["eligible"] and row["near_0.10"]


def test_delta_takes_first_programme_per_date_and_elapsed_days(spark):
    frame = master.add_threshold_flags(
        events(spark, [
            (1, "ASD", "2025-01-01 10:00:00", 1, "a", 9.5),
            (1, "AMOT", "2025-01-01 10:00:00", 1, "a", 9.5),
            (1, "AMOT", "2025-01-02 09:00:00", 2, "a", 9.0),
            (1, "AMOT", "2025-04-02 09:00:00", 3, "a", 9.4),
            (1, "AMOT", "2025-07-02 09:00:00", 4, "a", 9.1),
            (1, "AMOT", None, 5, "a", 8.0),
            (None, "AMOT", "2025-01-01", 6, "a", 8.0),
            (None, "AMOT", "2025-02-01", 7, "a", 8.0),
        ])
    )
    rows = history.build_delta_frame(frame).orderBy("score_id_ano").collect()
    assert [r["score_id_ano"] for r in rows] == [2, 3, 4, 5]
    assert [r["days_between"] for r in rows] == [0, 90, 91, None]
    assert [r["delta_distribue"] is None for r in rows] == [True, True, False, True]
    assert rows[2]["delta_distribue"] == pytest.approx((9.1 - 9.4) / 91)
    assert [r["status_change"] for r in rows] == ["gained", "lost", "gained", "stable"]


def test_timeline_skips_missing_scores_and_puts_missing_dates_last(spark):
    frame = master.add_threshold_flags(
        events(spark, [
            (1, "AMOT", "2025-01-01", 1, "a", None),
            (1, "AMOT", "2025-01-03", 2, "a", 9.0),
            (1, "AMOT", "2025-01-04 12:00:00", 3, "a", 10.0),
            (1, "AMOT", None, 4, "a", 11.0),
        ])
    )
    row = history.build_household_timeline(frame).collect()[0]
    assert (row["n_events"], row["score_first"], row["score_latest"]) == (3, 9.0, 11.0)
    assert (row["score_best"], row["score_worst"], row["days_active"]) == (9.0, 11.0, 3)
    assert (row["ever_eligible"], row["first_eligible"], row["currently_eligible"]) == (True, False, False)


def test_trajectory_status(spark):
    low, high = 8.0, 12.0
    plan = {1: [low, low], 2: [high, high], 3: [high, low], 4: [low, high], 5: [low, high, low], 6: [low, low]}
    rows = [
        (h, "AMOT", f"2025-0{k + 1}-01", h * 10 + k, "radiation" if h == 6 and k == 1 else "a", s)
        for h, path in plan.items()
        for k, s in enumerate(path)
    ]
    frame = history.build_household_trajectory(master.add_threshold_flags(events(spark, rows)))
    assert {r["menage_ano"]: r["statut_actuel"] for r in frame.collect()} == {
        1: "stable_eligible", 2: "stable_excluded", 3: "gained", 4: "lost", 5: "fluctuating", 6: "radiation",
    }
    assert history.radiated_households(frame).collect()[0][0] == 1


def test_beneficiary_records_after_the_event_drop_it(spark):
    frame = events(spark, [(1, "AMOT", "2025-01-10", 1, "a", 9.0), (2, "AMOT", "2025-01-10", 2, "a", 9.0),
                           (3, "AMOT", "2025-01-10", 3, "a", 9.0)])
    records = spark.createDataFrame(
        [(1, "P", day("2025-01-01")), (1, "P", day("2025-01-05")), (2, "P", day("2025-02-01"))],
        "menage_ano long, partner_id string, date_insert timestamp_ntz",
    )
    found = master.build_beneficiary_events(frame, records).collect()
    assert sorted(r["menage_ano"] for r in found) == [1, 1, 3]


def test_household_with_very_many_records_is_dealt_by_month(spark):
    """Every event with each earlier record and no other; records without a date always count."""
    frame = events(spark, [(1, "AMOT", f"2025-{m:02}-15", m, "a", 9.0) for m in range(1, 13)] + [
        (None, "AMOT", "2025-03-01", 90, "a", 9.0), (1, "AMOT", None, 91, "a", 9.0), (4, "AMOT", None, 92, "a", 9.0)])
    records = [(1, "P", day(f"2025-{m:02}-{d:02}")) for m in range(1, 13) for d in (1, 15, 16, 28)]
    records += [(1, "U", None), (None, "N", day("2025-01-01")), (None, "N", day("2026-01-01"))]
    table = spark.createDataFrame(records, "menage_ano long, partner_id string, date_insert timestamp_ntz")
    built = master.build_beneficiary_events(frame, table)
    found = sorted((r["score_id_ano"], str(r["beneficiaire_date_insert"])) for r in built.collect())
    expected = []
    for e in frame.collect():
        own = [d for h, _, d in records if h == e["menage_ano"]]
        for d in own or [None]:
            if d is None or (e["date_calcul"] is not None and d <= e["date_calcul"]):
                expected.append((e["score_id_ano"], str(d)))
    assert found == sorted(expected)


def test_pivot_functions_and_unknown_types(spark):
    frame = events(spark, [(1, "AMOT", "2025-01-01", 1, "x", 9.0), (1, "AMOT", "2025-01-02", 2, "x", 7.0),
                           (1, "AMOT", "2025-01-03", 3, "y", None)])
    assert master.pivot_values(frame) == ("x", "y")
    want = {"last": 7.0, "first": 9.0, "min": 7.0, "max": 9.0, "mean": 8.0, "count": 2}
    for how, value in want.items():
        row = master.build_pivot_wide(frame, how=how, values=("x", "y")).collect()[0]
        assert row["score_x"] == value
        assert row["score_y"] == (0 if how == "count" else None)


def test_missing_columns_are_errors(spark):
    frame = events(spark, [(1, "AMOT", "2025-01-01", 1, "x", 9.0)])
    with pytest.raises(ValueError):
        master.build_programme_frame(frame.drop("programme"), "AMOT")
    with pytest.raises(ValueError):
        stats.build_volatility_summary(frame, ["absent"])
    with pytest.raises(ValueError):
        stats.build_eligibility_churn(frame, ["programme"])


def test_household_lookup_is_pushed_to_the_scan(spark, tmp_path):
    frame = events(spark, [(1, "AMOT", "2025-01-01", 1, "x", 9.0)])
    frame.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m")).where("menage_ano = 1").select("score_final")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(menage_ano,1)" in plan and "programme" not in plan.split("ReadSchema")[1]


def test_deltas_of_stored_previous_events_shuffle_the_rows_once(spark):
    """Undated rows, ties and repeated ids included; attributes cross the network once."""
    random = np.random.default_rng(3)
    rows = []
    for i in range(600):
        date = None if i % 11 == 0 else f"2020-01-{random.integers(1, 9):02d}T0{random.integers(0, 3)}:00:00"
        rows.append((int(random.integers(0, 40)) or None, ("AMOT", "ASD")[i % 2], date, i // 2, "a", float(random.integers(6, 12))))
    frame = master.add_threshold_flags(events(spark, rows)).withColumn("region", F.concat("type_demande", "programme"))
    columns = ["menage_ano", "date_calcul", "programme", "score_id_ano", "score_avant", "score_apres", "date_avant", "status_change"]
    previous = history.previous_events(frame)
    found = history.build_delta_frame(frame, previous=previous)
    plain = history.build_delta_frame(frame)
    assert found.columns == plain.columns
    want = sorted(map(str, plain.select(*columns).collect()))
    assert len(want) > 100 and sorted(map(str, found.select(*columns).collect())) == want
    states = history.build_household_trajectory(frame).collect()
    assert sorted(map(str, history.build_household_trajectory(frame, previous=previous).collect())) == sorted(map(str, states))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = re.findall(r"\) Exchange\s*\nInput \[\d+\]: (.*)", text)
    assert len(sent) >= 4 and sum("region#" in columns for columns in sent) == 1
