import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crossgrid.functions.ops import OPERATORS
from crossgrid.plans.formula import EvalError, checked, evaluate
from crossgrid.plans.queries import OPERATOR_FORMULAS

DAY0 = dt.date(2020, 1, 1)
FIELDS = "date date, symbol string, pos int, open double, high double, low double, close double, volume double, vwap double, n_trades double, returns double, delivery_pct double, size_proxy double, sector string, close_raw double, volume_raw double"


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def hand(spark):
    """Five days of A rising, B falling, C flat."""
    rows = []
    for t in range(5):
        for s, x in (("A", t + 1.0), ("B", 5.0 - t), ("C", 2.0)):
            rows.append((DAY0 + dt.timedelta(t), s, t, x, x, x, x, x * 10, x, x, None, None, x, {"A": "p", "B": "p", "C": None}[s], x, x))
    return frame(spark, rows)


def values(spark, rows, f):
    got = evaluate(rows, {"v": f}, ("pos", "symbol")).collect()
    return {(r.pos, r.symbol): r.v for r in got}


def test_by_hand(spark):
    h = hand(spark)
    rank = values(spark, h, "rank(close)")
    assert (rank[0, "A"], rank[0, "B"], rank[0, "C"]) == pytest.approx((1 / 3, 1.0, 2 / 3))
    assert rank[1, "A"] == pytest.approx(0.5) and rank[1, "C"] == pytest.approx(0.5)  # both are 2
    assert values(spark, h, "ts_mean(close, 3)")[2, "A"] == 2 and values(spark, h, "ts_mean(close, 3)")[1, "A"] is None
    assert values(spark, h, "ts_argmax(close, 3)")[4, "B"] == 2 and values(spark, h, "ts_argmax(close, 3)")[4, "C"] == 2
    assert values(spark, h, "decay_linear(close, 3)")[2, "A"] == pytest.approx((1 + 4 + 9) / 6)
    assert values(spark, h, "ts_rank(close, 4)")[4, "B"] == 0.25
    assert values(spark, h, "correlation(close, open, 3)")[4, "A"] == pytest.approx(1) and values(spark, h, "correlation(close, open, 3)")[4, "C"] is None
    assert values(spark, h, "sector_neutral(close, sector)")[0, "C"] is None and values(spark, h, "sector_neutral(close, sector)")[0, "A"] == -2
    assert values(spark, h, "scale(close)")[0, "A"] == pytest.approx(1 / 8)
    assert values(spark, h, "zscore_cs(sub(close, close))")[0, "A"] is None
    assert values(spark, h, "div(close, sub(open, close))")[0, "A"] is None
    assert values(spark, h, "pow(sub(0, close), 0.5)")[0, "A"] is None and values(spark, h, "log(sub(0, close))")[0, "A"] is None
    assert values(spark, h, "min(close, returns)")[0, "A"] is None
    assert values(spark, h, "if_else(returns, 1, 2)")[0, "A"] is None and values(spark, h, "if_else(0, 1, 2)")[0, "A"] == 2
    with pytest.raises(EvalError):
        checked("ts_mean(close, 0)")
    with pytest.raises(EvalError):
        checked("ts_mean(close)")


def test_no_operator_looks_ahead(spark):
    """What happens after a day changes nothing on it, and something from it on."""
    r = random.Random(3)

    def rows(changed):
        out = []
        for t in range(40):
            for s in "ABCD":
                x = [r.uniform(1, 9) for _ in range(11)]
                if changed and t >= 25:
                    x = [v * 1.7 + 1 + t % 3 for v in x]
                out.append((DAY0 + dt.timedelta(t), s, t, *x[:9], x[9], "p" if s < "C" else "q", x[0], x[1]))
        return out

    r.seed(3)
    a = frame(spark, rows(False))
    r.seed(3)
    b = frame(spark, rows(True))
    fs = {k: f for k, f in OPERATOR_FORMULAS.items()}
    x = {(q.pos, q.symbol): q for q in evaluate(a, fs, ("pos", "symbol")).collect()}
    y = {(q.pos, q.symbol): q for q in evaluate(b, fs, ("pos", "symbol")).collect()}
    for k in fs:
        assert all(x[key][k] == y[key][k] for key in x if key[0] < 25), k
    moved = [k for k in fs if any(x[key][k] != y[key][k] for key in x if key[0] >= 25)]
    assert set(fs) - set(moved) <= {"div", "lt", "gt", "le", "ge", "eq", "sign", "rank"}
    assert set(OPERATORS) == set(fs)


def test_equal_subtrees_share_a_window(spark):
    plan = evaluate(hand(spark), {"a": "rank(delta(close, 2))", "b": "mul(-1, rank(delta(close, 2)))"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert evaluate(hand(spark), {"r": "rank(close)"}).where(F.isnan("r")).count() == 0
