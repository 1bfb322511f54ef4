"""Stocks, flows, churn and re-entries against literal loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from helpers import day, flagged

from hearthline.operators import flows


def random_flags(seed, n=600, hot=0.33):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        h = 0 if rng.random() < hot else rng.randrange(40)
        t = datetime(2024, 1, 1) + timedelta(days=rng.randrange(400), minutes=rng.randrange(1440))
        rows.append((h, rng.choice(["AMOT", "ASD"]), t.isoformat(), rng.random() < 0.5))
    return rows


def last_per_month(rows):
    months = defaultdict(dict)
    for h, p, t, e in sorted(rows, key=lambda r: r[2]):
        months[(p, day(t).replace(day=1, hour=0, minute=0))][h] = e
    return months


def test_churn_equals_loop(spark):
    rows = random_flags(3)
    found = {(r["programme"], r["date"]): r for r in flows.build_churn_timeline(flagged(spark, rows)).collect()}
    months = last_per_month(rows)
    assert set(found) == set(months)
    for p in ("AMOT", "ASD"):
        prev = {}
        for key in sorted(k for k in months if k[0] == p):
            start = sum(prev.values())
            entries = sum(1 for h, e in months[key].items() if h in prev and e and not prev[h])
            exits = sum(1 for h, e in months[key].items() if prev.get(h) and not e)
            prev.update(months[key])
            r = found[key]
            assert (r["pool_start"], r["pool_end"], r["entries"], r["exits"]) == (
                start, sum(prev.values()), entries, exits,
            )
            assert r["churn_rate"] == (exits / start if start else None)
            assert r["net_rate"] == ((entries - exits) / start if start else None)


def test_beneficiary_flows_equal_loop(spark):
    rows = random_flags(4)
    frame = spark.createDataFrame(
        [(h, p.lower(), day(t), e) for h, p, t, e in rows],
        "menage_ano long, partner_id string, date_insert timestamp_ntz, actif boolean",
    )
    found = {(r["programme"], r["date"]): r for r in flows.build_monthly_beneficiary_flows(frame).collect()}
    months = last_per_month(rows)
    assert set(found) == set(months)
    for p in ("AMOT", "ASD"):
        on, off = set(), set()
        for key in sorted(k for k in months if k[0] == p):
            up = down = 0
            for h, e in months[key].items():
                if e and h not in on:
                    off.discard(h)
                    on.add(h)
                    up += 1
                elif not e and h in on:
                    on.discard(h)
                    off.add(h)
                    down += 1
                elif not e:
                    off.add(h)
            r = found[key]
            assert (
                r["unique_menages_eligible"], r["unique_menages_not_eligible"],
                r["menages_became_eligible"], r["menages_became_ineligible"],
            ) == (len(on), len(off), up, down)


def test_monthly_flows_compare_with_the_last_observed_month(spark):
    rows = [
        (1, "AMOT", "2025-01-05", True),
        (1, "AMOT", "2025-03-05", False),
        (2, "AMOT", "2025-03-07", False),
        (2, "AMOT", "2025-04-07", True),
    ]
    found = flows.build_monthly_eligibility_flows(flagged(spark, rows)).collect()
    assert [tuple(r)[1:] for r in found] == [(1, 0, 1, 0, 1), (0, 2, 0, 1, 1), (1, 0, 1, 0, 1)]


def test_reentry_detail_equals_loop(spark):
    rows = random_flags(6)
    seen = {}
    for h, p, t, e in sorted(rows, key=lambda r: r[2]):
        seen.setdefault((h, p), []).append(e)
    found = flows.build_reentry_detail(flagged(spark, rows)).collect()
    assert len(found) == len(seen)
    for r in found:
        v = seen[(r["menage_ano"], r["programme"])]
        back = sum(1 for a, b in zip(v, v[1:]) if b and not a)
        assert (r["n_reentries"], r["ever_eligible"], r["ever_lost"]) == (back, any(v), not all(v))


def test_reentry_categories(spark):
    rows = [
        (h, "AMOT", d, e)
        for h, flags in {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, True)}.items()
        for d, e in zip(("2025-01-01", "2025-02-01"), flags)
    ]
    detail = flows.build_reentry_detail(flagged(spark, rows))
    summary = flows.build_reentry_summary(detail).collect()
    assert [(r["n_reentries"], r["n_menages"], r["pct_menages"]) for r in summary] == [
        ("toujours éligible", 1, 25.0),
        ("jamais éligible", 1, 25.0),
        ("perdu sans retour", 1, 25.0),
        ("1", 1, 25.0),
    ]


def test_empty_categories_are_listed(spark):
    rows = [(1, "ASD", "2025-01-01", True)]
    summary = flows.build_reentry_summary(flows.build_reentry_detail(flagged(spark, rows))).collect()
    assert [r["n_menages"] for r in summary] == [1, 0, 0]


def test_bucketed_reentries(spark):
    frame = spark.createDataFrame(
        [("A", "toujours éligible", 1, 10.0), ("A", "jamais éligible", 2, 20.0), ("A", "4", 3, 30.0),
         ("A", "5", 1, 10.0), ("A", "12", 3, 30.0)],
        "programme string, n_reentries string, n_menages long, pct_menages double",
    )
    found = flows.reentry_buckets(frame).collect()
    assert [(r["label"], r["n_menages"]) for r in found] == [
        ("toujours éligible", 1), ("jamais éligible", 2), ("4", 3), ("5+", 4),
    ]
