"""Exact quantiles and moments against the standard library."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hearthline.operators.quantiles import split_cells, value_profile

PROBS = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


def quantile(values, p):
    v = sorted(values)
    x = p * (len(v) - 1)
    low = math.floor(x)
    return v[low] + (v[math.ceil(x)] - v[low]) * (x - low)


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_profile_equals_statistics(spark, width):
    rng = random.Random(7)
    groups = {None: 40, "a": 900, "b": 1, "c": 2}
    data = []
    for g, n in groups.items():
        for _ in range(n):
            # a third of all rows share one value
            data.append((g, 3.25 if rng.random() < 0.33 else round(rng.gauss(0, 4), 3)))
    data += [("a", None)] * 5 + [("d", None)] * 3
    frame = spark.createDataFrame(data, "g string, x double")
    found = {r["g"]: r for r in value_profile(frame, ["g"], F.col("x"), PROBS, width).collect()}
    assert set(found) == {None, "a", "b", "c", "d"}
    for g in groups:
        v = [x for k, x in data if k == g and x is not None]
        r = found[g]
        assert r["n"] == len(v) and r["n_rows"] == sum(1 for k, _ in data if k == g)
        assert r["low"] == min(v) and r["high"] == max(v)
        assert r["mean"] == pytest.approx(statistics.fmean(v), abs=1e-9)
        want = statistics.stdev(v) if len(v) > 1 else None
        assert r["std"] == (want if want is None else pytest.approx(want, abs=1e-7))
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(quantile(v, p), abs=1e-12)
    d = found["d"]
    assert (d["n"], d["n_rows"], d["mean"], d["median"], d["std"]) == (0, 3, None, None, None)


def test_equal_values_have_no_spread(spark):
    frame = spark.range(1000).select(F.lit(9.3264284).alias("x"))
    row = value_profile(frame, [], F.col("x"), {"median": 0.5}, 0.01).collect()[0]
    assert row["std"] == pytest.approx(0.0, abs=1e-6)
    assert row["median"] == 9.3264284


def test_extras_ride_along(spark):
    frame = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (-1.0,)], "x double")
    row = value_profile(
        frame, [], F.abs("x"), {}, 0.01,
        carry={"neg": F.col("x") < 0},
        extras={"falls": F.when(F.col("neg"), F.col("c")).otherwise(F.lit(0))},
    ).collect()[0]
    assert (row["n"], row["falls"]) == (4, 2)


def test_distinct_values_within_one_cell(spark):
    """All values of a group lie in one cell; parts of it are ranked alone."""
    rng = random.Random(3)
    data = [(g, 5 + rng.random() / 101) for g in ("a", "b", None) for _ in range(4000)]
    frame = spark.createDataFrame(data, "g string, x double")
    found = {r["g"]: r for r in value_profile(frame, ["g"], F.col("x"), PROBS, 0.01).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in data if k == g]
        assert (found[g]["low"], found[g]["high"]) == (min(v), max(v))
        for name, p in PROBS.items():
            assert found[g][name] == pytest.approx(quantile(v, p), abs=1e-12)
    counts = frame.groupBy("g", F.lit(500).alias("cell"), F.col("x").alias("v")).agg(F.count("*").alias("c"))
    wanted = counts.withColumns({"before": F.lit(0), "i": F.lit(0), "low": F.lit(2000), "high": F.lit(2000), "weight": F.lit(0.0)})
    per_part = split_cells(wanted, ["g"], 0.01).groupBy("g").count().collect()
    assert len(per_part) == 3 and all(r["count"] < 40 for r in per_part)
