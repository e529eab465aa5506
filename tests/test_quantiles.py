"""Exact quantiles against numpy, and the order of doubles as longs."""

import math
import random
import struct

import numpy as np
from crossgrid.functions import quantiles as q
from pyspark.sql import functions as F


def bits(x):
    k = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -k if x < 0 else k


def test_doubles_as_longs(spark):
    r = random.Random(3)
    xs = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 0.1, math.pi]
    xs += [s * math.ldexp(m, e) for e in range(-1074, 1024) for m, s in ((1.0, 1), (1.5, -1), (1 - 2**-53, 1), (1 + 2**-52, -1))]
    xs += [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", q.to_ordered(F.col("x")).alias("k")).select("x", "k", q.from_ordered(F.col("k")).alias("back")).collect()
    for row in rows:
        if math.isnan(row.x):
            assert row.k is None
        else:
            assert row.k == bits(row.x) and row.back == row.x


def test_equals_numpy_by_key(spark):
    r, rows = random.Random(7), []
    for key, n in (("a", 1), ("b", 2), (None, 301), ("c", 1000), ("none", 0)):
        rows += [(key, 1, r.choice([r.gauss(0, 1), r.gauss(0, 1e-9), float(r.randint(-3, 3)), 1e300 * r.random()])) for _ in range(n)]
    rows += [("none", 1, None), ("c", 1, None), ("c", 1, float("nan")), ("b", 2, 7.0)] + [("hot", 1, 0.25)] * 500
    qs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "key string, part int, v double")
    got = {(x.key, x.part, x.q): x.value for x in q.quantiles(df, F.col("v"), qs, "key", "part").collect()}
    want = {}
    for key, part in {x[:2] for x in rows}:
        v = [x[2] for x in rows if x[:2] == (key, part) and x[2] is not None and not math.isnan(x[2])]
        if v:
            want |= {(key, part, i): float(np.quantile(v, p)) for i, p in enumerate(qs)}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-300) for k in want)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(10)], "v double")
    assert [(x.q, x.value) for x in q.quantiles(df, F.col("v"), (0.5,)).collect()] == [(0, 4.5)]
    assert q.quantiles(df.where("v > 99"), F.col("v"), (0.5,)).collect() == []


def test_counts_are_bounded_before_the_shuffle(spark):
    """However many values: a pass moves counts of digits, not values."""
    df = spark.range(200_000).select((F.col("id") % 1000 / 7).alias("v"))
    assert [round(x.value, 9) for x in q.quantiles(df, F.col("v"), (0.5,)).collect()] == [round(999 / 14, 9)]
