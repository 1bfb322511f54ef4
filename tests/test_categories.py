"""Categories that no list names: nothing of them is lost."""

import pytest

from hearthline.functions import columns
from hearthline.functions.columns import category_values
from hearthline.operators.demography import household_size, mean_household_size
from hearthline.operators.master import build_pivot_wide
from hearthline.operators.stats import volatility_heatmap
from hearthline.plans.job import read_scores
from helpers import events


def test_unlisted_types_make_columns(spark):
    frame = events(spark, [(1, "X", "2025-01-01", 1, "Inscription", 5.0), (1, "X", "2025-02-01", 2, "autre", 6.0),
                           (2, "Y", "2025-01-01", 3, None, 7.0)])
    rows = {(r["menage_ano"], r["programme"]): r for r in build_pivot_wide(frame).collect()}
    assert set(rows) == {(1, "X"), (2, "Y")}
    assert (rows[1, "X"]["score_Inscription"], rows[1, "X"]["score_autre"]) == (5.0, 6.0)
    listed = build_pivot_wide(frame, values=("radiation",)).collect()
    assert len(listed) == 2 and {r["score_radiation"] for r in listed} == {None}


def test_unlisted_programmes_make_columns(spark):
    frame = spark.createDataFrame([("a", "NEW", 1.0), ("a", "AMOT", 2.0), ("b", "NEW", 3.0)], "region string, programme string, mean_delta double")
    found = {r["region"]: r.asDict() for r in volatility_heatmap(frame).collect()}
    assert found["a"] == {"region": "a", "AMOT": 2.0, "NEW": 1.0} and found["b"]["NEW"] == 3.0


def test_too_many_categories_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(columns, "MAX_COLUMNS", 5)
    with pytest.raises(ValueError, match="more than 5"):
        category_values(spark.range(10), "id")


def test_mean_size_counts_large_households(spark):
    homes = spark.createDataFrame([(2,), (4,), (30,), (None,)], "taille_menage long")
    assert mean_household_size(homes).collect()[0][0] == 12.0
    assert household_size(homes).count() == 2 and household_size(homes, max_size=40).count() == 3


def test_scores_from_parquet_and_csv(spark, tmp_path):
    head = "menage_ano,score_id_ano,type_demande,score_corrige,score_calcule,date_calcul\n"
    (tmp_path / "a.csv").write_text(head + "1,10,a,,5.0,2025-01-01\n2,20,a,,7.0,2025-01-01\n")
    (tmp_path / "b.csv").write_text(head + "3,20,a,,8.0,2025-02-01\n4,40,a,,99.0,2025-01-01\n")
    _, first = read_scores(spark, [str(tmp_path / "a.csv")], 15.0, str(tmp_path / "w1"))
    first.write.parquet(str(tmp_path / "ready.parquet"))
    raw, clean = read_scores(spark, [str(tmp_path / "ready.parquet"), str(tmp_path / "b.csv")], 15.0, str(tmp_path / "w2"))
    assert raw.count() == 4
    assert {(r["score_id_ano"], r["menage_ano"]) for r in clean.collect()} == {(10, 1), (20, 3)}
