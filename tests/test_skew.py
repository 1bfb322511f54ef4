"""Plans and results when one household or one value holds a large share of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from hearthline.operators import flows, history, master, sequence, stats
from hearthline.operators.dedup import keep_one
from hearthline.operators.sequence import with_previous


@pytest.fixture
def hot(spark):
    """9 000 events, a third of them of household 0, a third with one score."""
    n = F.col("id")
    rows = spark.range(9000).select(
        F.when(n % 3 == 0, F.lit(0)).otherwise(n % 500 + 1).alias("menage_ano"),
        n.alias("score_id_ano"),
        F.lit("AMOT").alias("programme"),
        F.when(n % 7 == 0, F.lit("radiation")).otherwise(F.lit("inscription")).alias("type_demande"),
        F.timestamp_add(
            "MINUTE", F.pmod(F.hash(n), F.lit(1_000_000)), F.lit("2020-01-01").cast("timestamp_ntz")
        ).alias("date_calcul"),
        F.when(n % 3 == 1, F.lit(9.5)).otherwise(F.pmod(F.hash(n + 1), F.lit(9000)) / 1000 + 6).alias("score_final"),
    )
    return master.add_threshold_flags(rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_previous_row_is_right_for_a_hot_household(spark, hot):
    found = with_previous(hot, ["menage_ano"], "date_calcul", ["score_id_ano"], ["score_id_ano"])
    got = {r["score_id_ano"]: r["previous"] and r["previous"]["score_id_ano"] for r in found.collect()}
    rows = sorted((r["menage_ano"], r["date_calcul"], r["score_id_ano"]) for r in hot.collect())
    want, last = {}, {}
    for h, _, i in rows:
        want[i] = last.get(h)
        last[h] = i
    assert got == want


def test_hot_hour_and_undated_rows_are_spread(spark, monkeypatch):
    """A third of all rows in one hour of one household, a third without a date."""
    monkeypatch.setattr(sequence, "UNDATED", 64)
    n = F.col("id")
    hour = F.timestamp_add("SECOND", F.pmod(F.hash(n), F.lit(3600)), F.lit("2020-01-01").cast("timestamp_ntz"))
    rows = spark.range(6000).select(
        F.when(n % 3 == 2, n % 40 + 1).otherwise(F.lit(0)).alias("menage_ano"),
        F.when(n % 97 != 0, n).alias("score_id_ano"),
        n.alias("row"),
        F.when(n % 3 != 1, hour).alias("date_calcul"),
    )
    found = with_previous(rows, ["menage_ano"], "date_calcul", ["score_id_ano", "row"], ["row"])
    got = {r["row"]: r["previous"] and r["previous"]["row"] for r in found.collect()}

    def place(r):
        late = [(x is None, x if x is not None else 0) for x in (r["score_id_ano"], r["row"])]
        return r["menage_ano"], r["date_calcul"] is None, str(r["date_calcul"]), *late

    want, last = {}, {}
    for r in sorted(rows.collect(), key=place):
        want[r["row"]] = last.get(r["menage_ano"])
        last[r["menage_ano"]] = r["row"]
    assert got == want
    columns = r"_day#\d+, _hour#\d+, _slot#\d+L?"
    assert re.search(rf"hashpartitioning\(menage_ano#\d+L?, {columns}", plan_of(found))


def test_first_window_is_cut_by_hour(hot):
    df = with_previous(hot, ["menage_ano"], "date_calcul", ["score_id_ano"], ["score_final"])
    plan = plan_of(df)
    cut = re.findall(r"hashpartitioning\(menage_ano#\d+L?, _day#\d+, _hour#\d+", plan)
    assert cut
    # what crosses the hours is only the first row of each
    assert "(_at#" in plan


def test_copies_are_limited_before_the_shuffle(hot):
    plan = plan_of(keep_one(hot, ["menage_ano"], [F.col("date_calcul").asc()]))
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


def test_deltas_and_reentries_of_a_hot_household(hot):
    seen = sorted((r["date_calcul"], r["score_id_ano"], r["eligible"]) for r in hot.where("menage_ano = 0").collect())
    back = sum(1 for a, b in zip(seen, seen[1:]) if b[2] and not a[2])
    detail = flows.build_reentry_detail(hot).where("menage_ano = 0").collect()[0]
    assert detail["n_reentries"] == back
    dates = {d for d, _, _ in seen}
    assert history.build_delta_frame(hot).where("menage_ano = 0").count() == len(dates) - 1


def test_sample_is_the_smallest_digests(hot):
    delta = history.build_delta_frame(hot)
    rows = delta.where("delta_distribue IS NOT NULL").select(
        "score_id_ano", F.md5(F.concat_ws("-", "menage_ano", "score_id_ano", "programme")).alias("d")
    )
    want = {r[0] for r in rows.orderBy("d").limit(20).collect()}
    assert {r["score_id_ano"] for r in stats.delta_sample(delta, 20).collect()} == want
    assert stats.delta_sample(delta, 1_000_000).count() == rows.count()


def test_no_pairwise_or_nested_loop_joins(spark, hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            stats.weekly_abs_delta(history.build_delta_frame(hot)),
            stats.score_stats(hot),
            history.build_household_trajectory(hot),
            flows.build_reentry_summary(flows.build_reentry_detail(hot)),
        ):
            plan = plan_of(df)
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
