"""Least squares on many, also dependent, columns against numpy's fit of least norm."""

import random

import numpy as np
import pytest
from crossgrid.functions.linear import residuals
from crossgrid.plans import gates
from pyspark.sql import functions as F

NAMES = [f"f{k}" for k in range(6)]
SCHEMA = "date string, symbol int, y double, " + ", ".join(f"{n} double" for n in NAMES)


def world():
    r = random.Random(5)
    rows = []
    for date, n in (("a", 40), ("b", 9), ("c", 7), ("d", 0), (None, 25)):
        for s in range(n):
            f = [r.gauss(0, 1) for _ in range(6)]
            f[2] = f[0]  # twice the same
            f[3] = 1e6 + 1e-3 * f[3]  # small moves about a large mean
            f[4] = 2 * f[0] - 3 * f[1] + 5  # a sum of others
            f[5] = 7.0 if date == "b" else f[5] * 1e-8  # constant on one date, tiny on others
            y = f[0] - 2 * f[1] + 1e8 * f[5] * (date != "b") + r.gauss(0, 0.3)
            rows.append((date, s, None if s == 3 else y, *[None if s == 5 and k == 1 else v for k, v in enumerate(f)]))
    return rows


def expected(rows, k):
    out = {}
    for date in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == date]
        known = [r for r in own if all(v is not None for v in r[2 : 3 + k])]
        out |= {(date, r[1]): r[2] for r in own}
        if len(known) >= k + 2 and date is not None:
            x = np.array([[1.0, *r[3 : 3 + k]] for r in known])
            x[:, 1:] -= x[:, 1:].mean(0)
            x[:, 1:] /= np.where(x[:, 1:].std(0) > 1e-14, x[:, 1:].std(0), 1)
            y = np.array([r[2] for r in known])
            out |= {(date, r[1]): v for r, v in zip(known, y - x @ np.linalg.lstsq(x, y, rcond=1e-9)[0])}
    return out


@pytest.mark.parametrize("k", [1, 3, 6])
def test_equals_fit_of_least_norm(spark, k):
    rows = world()
    got = {(r.date, r.symbol): r.resid for r in residuals(spark.createDataFrame(rows, SCHEMA), "y", NAMES[:k], "resid", "date").collect()}
    want = expected(rows, k)
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert (got[key] is None) == (v is None) and (v is None or abs(got[key] - v) < 1e-6), (key, got[key], v)


def test_no_columns_and_no_rows(spark):
    df = spark.createDataFrame(world(), SCHEMA)
    assert gates.orthogonalize(df, "y", []).where("NOT (resid <=> y)").count() == 0
    assert gates.orthogonalize(df.where("false"), "y", NAMES).count() == 0


def test_a_target_that_depends_on_the_columns_has_zeros(spark):
    df = spark.createDataFrame(world(), SCHEMA).withColumn("y", 3 * F.col("f0") - F.col("f1") + 9)
    assert {r.resid for r in residuals(df.where("f1 IS NOT NULL AND date = 'a'"), "y", NAMES[:4], "resid", "date").collect()} == {0.0}


def test_moments_are_combined_before_the_shuffle(spark):
    df = residuals(spark.range(100).selectExpr("id % 5 AS date", "id * 1.0D AS y", "id * id * 1.0D AS f0"), "y", ["f0"], "resid", "date")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_covar_pop" in plan and "SinglePartition" not in plan and "Window" not in plan
