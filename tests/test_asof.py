"""Running-state series against a literal loop over period points."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from helpers import events

from hearthline.operators import asof, master


def monday(t):
    d = datetime(t.year, t.month, t.day)
    return d - timedelta(days=d.weekday())


def quantile(values, p):
    v = sorted(values)
    x = p * (len(v) - 1)
    low = math.floor(x)
    return v[low] + (v[math.ceil(x)] - v[low]) * (x - low)


def loop_states(rows, step):
    """State per household at each point, from the rules, one event after another."""
    rows = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0], r[3]))
    t0, t1 = rows[0][2], rows[-1][2]
    first = {}
    for r in rows:
        first.setdefault(r[0], r)
    moved = {h for h, r in first.items() if r[4] != "inscription" and r[2] > t0}
    seq = [(t0, -1, h, first[h]) for h in moved]
    seq += [(r[2], r[3], r[0], r) for r in rows if not (r[0] in moved and r[2] == first[r[0]][2])]
    seq.sort(key=lambda x: x[:2])
    floor = monday if step == 7 else lambda t: datetime(t.year, t.month, t.day)
    point, last, state, at = floor(t0), floor(t1), {}, 0
    while point <= last:
        while at < len(seq) and seq[at][0] <= point:
            _, _, h, r = seq[at]
            if r[4] == "radiation" or r[5] is None:
                state.pop(h, None)
            else:
                state[h] = r
            at += 1
        yield point, dict(state)
        point += timedelta(days=step)


def random_rows(seed, households=40, n=500, days=300, hot=0.33):
    rng = random.Random(seed)
    kinds = ["inscription", "mise à jour du dossier", "radiation", "réclamation"]
    rows = []
    for i in range(n):
        h = 0 if rng.random() < hot else rng.randrange(households)
        t = datetime(2024, 1, 3) + timedelta(days=rng.randrange(days), hours=rng.choice([0, 0, 7]))
        score = None if rng.random() < 0.03 else rng.choice([9.0, round(rng.uniform(6, 15), 4)])
        rows.append((h, "AMOT", t, i, rng.choice(kinds), score))
    return rows


@pytest.mark.parametrize("freq,step", [("W-MON", 7), ("D", 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_series_equals_loop(spark, seed, freq, step):
    rows = random_rows(seed)
    found = {
        r["date_calcul"]: r
        for r in asof.build_score_timeseries(events(spark, rows), freq).collect()
    }
    expected = {
        p: [r[5] for r in s.values()] for p, s in loop_states(rows, step) if s
    }
    assert set(found) == set(expected)
    for p, v in expected.items():
        r = found[p]
        assert r["n_menages"] == len(v)
        for name, want in {
            "score_mean": statistics.fmean(v),
            "score_median": quantile(v, 0.5),
            "score_std": statistics.pstdev(v),
            "score_min": min(v),
            "score_max": max(v),
            "score_p10": quantile(v, 0.1),
            "score_p25": quantile(v, 0.25),
            "score_p75": quantile(v, 0.75),
            "score_p90": quantile(v, 0.9),
        }.items():
            assert r[name] == pytest.approx(want, abs=1.1e-6), (p, name)


@pytest.mark.parametrize("step,freq", [(7, "W-MON"), (1, "D")])
def test_scores_crowded_in_one_cell(spark, monkeypatch, step, freq):
    """All scores within 0.02, a third of them equal: only parts of the cell meet the points."""
    rng = random.Random(3)
    rows = [
        (*r[:5], None if r[5] is None else 9.01 if r[5] == 9.0 else 9.0001 + round(rng.random(), 9) * 0.0198)
        for r in random_rows(3, households=200, n=900, hot=0.1)
    ]
    seen = []
    read = asof.pick_values

    def spy(counts, keys, *rest):
        seen.append(counts.groupBy(*keys, "cell", "i", "part").count().agg({"count": "max"}).first()[0])
        return read(counts, keys, *rest)

    monkeypatch.setattr(asof, "pick_values", spy)
    frame = events(spark, rows)
    assert asof.crowding(frame) is None and asof.crowding(frame, 4) == 4
    found = {r["date_calcul"]: r for r in asof.build_score_timeseries(frame, freq, crowded=4).collect()}
    expected = {p: [r[5] for r in s.values()] for p, s in loop_states(rows, step) if s}
    assert set(found) == set(expected)
    assert max(map(len, expected.values())) > 100 and seen[0] <= 8
    for p, v in expected.items():
        r = found[p]
        assert (r["n_menages"], r["score_min"], r["score_max"]) == (
            len(v), pytest.approx(min(v), abs=1e-6), pytest.approx(max(v), abs=1e-6),
        )
        for name, level in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)):
            assert r[f"score_{name}"] == pytest.approx(quantile(v, level), abs=1.1e-6), (p, name)


def test_near_threshold_equals_loop(spark):
    rows = [r if r[0] % 2 else (r[0], "ASD", *r[2:]) for r in random_rows(5)]
    frame = master.add_threshold_flags(events(spark, rows))
    bands = (0.29, 0.5)
    found = {
        (r["week"], r["programme"]): r
        for r in asof.build_near_threshold_timeseries(frame, bands=bands).collect()
    }
    limits = {"AMOT": 9.3264284, "ASD": 9.743001}
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    point, last, state, at = monday(ordered[0][2]), monday(ordered[-1][2]), {}, 0
    seen = set()
    while point <= last:
        while at < len(ordered) and ordered[at][2] <= point:
            r = ordered[at]
            key = (r[0], r[1])
            state.pop(key, None)
            if r[4] != "radiation" and r[5] is not None:
                state[key] = r[5]
            at += 1
        for p in ("AMOT", "ASD"):
            v = [s for (_, q), s in state.items() if q == p]
            if not v:
                continue
            seen.add((point, p))
            r = found[(point, p)]
            assert r["n_total"] == len(v)
            for b in bands:
                sfx = f"{int(b * 100):03d}"
                d = [(s, s - limits[p]) for s in v]
                for name, inside in (
                    (sfx, [s for s, x in d if abs(x) <= b]),
                    (f"{sfx}_neg", [s for s, x in d if -b <= x < 0]),
                    (f"{sfx}_pos", [s for s, x in d if 0 < x <= b]),
                ):
                    assert r[f"n_near_{name}"] == len(inside)
                    if inside:
                        assert r[f"mean_score_{name}"] == pytest.approx(statistics.fmean(inside), abs=1.1e-6)
                        assert r[f"median_score_{name}"] == pytest.approx(quantile(inside, 0.5), abs=1.1e-6)
                    else:
                        assert r[f"mean_score_{name}"] is None
        point += timedelta(days=7)
    assert set(found) == seen
    assert "n_near_028" in next(iter(found.values())).asDict()  # 0.29 is truncated


def test_weekly_percentiles_of_two_mondays(spark):
    rows = [
        (h, "AMOT", d, i, "inscription", s)
        for i, (h, d, s) in enumerate(
            [(1, "2025-01-06", 8.0), (2, "2025-01-06", 10.0), (3, "2025-01-06", 12.0),
             (1, "2025-01-13", 7.5), (2, "2025-01-13", 9.5), (3, "2025-01-13", 11.5)]
        )
    ]
    found = asof.build_score_timeseries(events(spark, rows)).orderBy("date_calcul").collect()
    assert [(r["n_menages"], r["score_mean"]) for r in found] == [(3, 10.0), (3, 9.5)]
    assert [r["score_p10"] for r in found] == [8.4, 7.9]
    assert all(r[c] is not None for r in found for c in ("score_p25", "score_p75", "score_p90"))


def test_removal_clears_and_return_restores(spark):
    rows = [
        (1, "AMOT", "2025-01-06", 1, "inscription", 9.0),
        (2, "AMOT", "2025-01-06", 2, "inscription", 8.0),
        (1, "AMOT", "2025-01-14", 3, "Radiation ", 9.0),
        (1, "AMOT", "2025-01-28", 4, "réclamation", 7.0),
        (2, "AMOT", "2025-02-03", 5, "réclamation", 8.0),
    ]
    found = asof.build_score_timeseries(events(spark, rows)).orderBy("date_calcul").collect()
    assert [(r["date_calcul"].day, r["n_menages"]) for r in found] == [
        (6, 2), (13, 2), (20, 1), (27, 1), (3, 2),
    ]


def test_late_first_event_counts_from_the_start(spark):
    rows = [
        (1, "AMOT", "2025-01-06", 1, "inscription", 9.0),
        (2, "AMOT", "2025-01-22", 2, "mise à jour du dossier", 7.0),
        (2, "AMOT", "2025-01-22", 3, "réclamation", 5.0),
        (3, "AMOT", "2025-01-22", 4, "inscription", 6.0),
        (1, "AMOT", "2025-01-27", 5, "réclamation", 9.0),
    ]
    found = asof.build_score_timeseries(events(spark, rows)).orderBy("date_calcul").collect()
    # household 2 is present from the first week with its first score and keeps it
    assert [(r["n_menages"], r["score_min"]) for r in found] == [(2, 7.0)] * 3 + [(3, 6.0)]


def test_segments_need_two_households(spark):
    rows = [(h, "AMOT", "2025-01-06", h, "inscription", 8.0 + h) for h in (1, 2, 3)]
    frame = events(spark, rows).selectExpr(
        "*", "IF(menage_ano < 3, 'Urbain', 'Rural') AS milieu", "' ' AS region", "CAST(NULL AS STRING) AS genre_cm"
    )
    found = asof.build_score_timeseries(frame, segments=("milieu", "region", "genre_cm")).collect()
    assert {(r["milieu"], r["region"], r["n_menages"]) for r in found} == {
        (None, None, 3), ("Urbain", None, 2),
    }
    by = {r["milieu"]: r["score_std"] for r in found}
    assert by["Urbain"] == pytest.approx(statistics.stdev([9, 10]), abs=1e-6)
    assert by[None] == pytest.approx(statistics.pstdev([9, 10, 11]), abs=1e-6)


def test_no_dated_events_gives_no_rows(spark):
    rows = [(1, "AMOT", None, 1, "inscription", 9.0)]
    frame = master.add_threshold_flags(events(spark, rows))
    assert asof.build_score_timeseries(frame).count() == 0
    assert asof.build_near_threshold_timeseries(frame).count() == 0


def test_bands_that_truncate_alike_have_columns_of_their_own():
    assert asof.band_suffixes((0.10, 0.25, 0.50)) == {0.10: "010", 0.25: "025", 0.50: "050"}
    assert asof.band_suffixes((0.28, 0.29)) == {0.28: "0280", 0.29: "0290"}
    assert asof.band_suffixes((0.1, 0.105, 1.0)) == {0.1: "0100", 0.105: "0105", 1.0: "100"}
