"""The universe's fringe: bands of small and large months, the month that governs a date, and where ranks come from."""

import ast
from datetime import date, timedelta
from pathlib import Path

import pytest
from crossgrid.plans import queries, redteam


def panel(spark, names, days=70):
    first = date(2000, 1, 3)
    rows = [(first + timedelta(k), f"n{i:03}", k, float(1000 - i) if k > 40 or i % 2 else None) for k in range(days) for i in range(names)]
    return spark.createDataFrame(rows, "date date, symbol string, pos int, size_proxy double")


def expected(rows, names_by_month):
    """Plain Python: rank-ordered names per month end, cut by the rule, and the last end before each date."""
    ends = sorted(names_by_month)
    out = set()
    for d in {r.date for r in rows}:
        before = [e for e in ends if e < d]
        names = names_by_month[before[-1] if before else ends[0]]
        out |= {(d, s) for s in (names[149:200] if len(names) >= 200 else names[int(round(len(names) * (150 / 200))) :])}
    return out


@pytest.mark.parametrize("names", [25, 199, 300])
def test_band_by_the_size_of_the_month(spark, names):
    rows = panel(spark, names)
    local = rows.collect()
    ends = {max(r.date for r in local if (r.date.year, r.date.month) == m) for m in {(r.date.year, r.date.month) for r in local}}
    ranked = {e: [r.symbol for r in sorted((r for r in local if r.date == e and r.size_proxy is not None), key=lambda r: (-r.size_proxy, r.symbol))] for e in ends}
    got = redteam.fringe(rows).collect()
    assert {(r.date, r.symbol) for r in got} == expected(local, ranked) and len(got) == len({(r.date, r.symbol) for r in got})
    assert {r.source for r in got} == {"panel"}


def test_supplied_ranks_are_used_if_they_name_the_panel(spark):
    rows = panel(spark, 20)
    ranks = [(date(2000, 1, 20), f"n{19 - i:03}", i + 1) for i in range(20)] + [(date(2000, 2, 20), "other", 1)]
    got = redteam.fringe(rows, spark.createDataFrame(ranks, "month_end date, symbol string, liquidity_rank int")).collect()
    assert {r.source for r in got} == {"supplied"}
    assert {r.symbol for r in got} == {f"n{k:03}" for k in range(5)} and max(r.date for r in got) == date(2000, 2, 20)
    strange = spark.createDataFrame([(date(2000, 1, 20), "x", 1)], "month_end date, symbol string, liquidity_rank int")
    same = lambda d: sorted((r.date, r.symbol) for r in d.collect())
    assert same(redteam.fringe(rows, strange)) == same(redteam.fringe(rows))


def test_names_of_queries_are_given_once():
    with pytest.raises(ValueError, match="two queries"):
        queries.query("panel_ohlcv")(lambda spark, sf_dir: None)
    from crossgrid import registry

    used = 0
    for path in Path(queries.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.FunctionDef):
                used += sum(isinstance(d, ast.Call) and getattr(d.func, "id", "") == "query" and isinstance(d.args[0], ast.Constant) for d in node.decorator_list)
    assert 100 < used <= len(registry.queries())
