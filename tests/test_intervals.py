"""Interval joins against comparing all with all."""

import random

import pytest

from hetspark.operators import fit, intervals


@pytest.mark.parametrize("width", [None, 0.7, 5.0, 1000.0])
def test_like_all_pairs(spark, width):
    rng = random.Random(1)
    values = [(i, rng.choice([None, rng.randrange(-50, 50), rng.uniform(-50, 50)])) for i in range(300)]
    values = [(i, None if v is None else float(v)) for i, v in values]
    spans = [(j, float(a), float(a + rng.choice([-3, 0, 1, 2.5, 40]))) for j, a in enumerate(rng.randrange(-60, 60) for _ in range(120))] + [(900, None, 3.0), (901, 0.0, None)]
    df, other = spark.createDataFrame(values, "i int, v double"), spark.createDataFrame(spans, "j int, low double, high double")
    got = sorted((r.i, r.j) for r in intervals.interval_join(df, "v", other, width).collect())
    assert got == sorted((i, j) for i, v in values for j, a, b in spans if None not in (v, a, b) and a < v < b)
    assert "NestedLoop" not in intervals.interval_join(df, "v", other, width)._jdf.queryExecution().executedPlan().toString()


def test_cells_of_the_net(spark):
    """The net's cells, found by two interval joins, are those of fit.in_cells()."""
    rng = random.Random(2)
    rows = [(b, b + rng.randrange(60), rng.randrange(1, 99), rng.choice([-1, 0, 3])) for b in range(2, 60) for _ in range(3)]
    labelled = spark.createDataFrame(rows, "covB int, covA int, freq bigint, smudge int")
    covs = [4.0, 7.5, 12.0]
    clean = labelled.where("smudge <> -1")
    b = intervals.interval_join(clean, "covB", intervals.net(labelled, covs, 8)).withColumnRenamed("n", "b").drop("low", "high")
    both = intervals.interval_join(b, "covA", intervals.net(labelled, covs, 15).withColumnRenamed("n", "a"), on=("cov",)).where("a >= b and a + b <= 16")
    want = sorted(tuple(r) for r in fit.in_cells(labelled, covs).select("covB", "covA", "freq", "cov", "a", "b").collect())
    assert want and sorted(tuple(r) for r in both.select("covB", "covA", "freq", "cov", "a", "b").collect()) == want


def test_empty_sides(spark):
    df, none = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([], "low double, high double")
    assert intervals.interval_join(df, "v", none).collect() == [] == intervals.interval_join(df.where("false"), "v", spark.createDataFrame([(0.0, 2.0)], "low double, high double")).collect()
