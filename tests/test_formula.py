import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossgrid.functions.ops import OPERATORS
from crossgrid.functions.stats import deflated_sharpe, expected_max_sharpe
from crossgrid.plans import formula, zoo
from crossgrid.plans.queries import OPERATOR_FORMULAS
from crossgrid.plans.redteam import delivery_lag


@pytest.mark.parametrize("bad", ["close.x", "[c for c in close]", "lambda x: x", "close[0]", "f'{close}'", "__import__('os')", "rank(close, key=1)", "rank(*close)", "-close", "True", "unknown(close)", "price", "close if open else low", "'a'", "", "1 < 2", "a := 1"])
def test_rejects(bad):
    with pytest.raises(formula.ParseError):
        formula.parse(bad)


def test_shapes():
    assert formula.canonical("rank(close) * 2 + 3/4") == "add(0.75,mul(2,rank(close)))"
    assert formula.canonical("div(1, 0)") == "div(1,0)"
    assert formula.canonical("correlation(volume, close, 5)") == "correlation(close,volume,5)"
    assert formula.canonical("sub(volume, close)") == "sub(volume,close)"
    assert formula.complexity("rank(delta(close, 5))") == {"nodes": 4, "depth": 3, "free_params": 1}
    assert formula.structural_key("delta(close, 5)") == formula.structural_key("delta(close, 12)") != formula.structural_key("delta(open, 5)")
    assert formula.fingerprint("delta(close, 5)") == formula.fingerprint("delta(close, 7)") != formula.fingerprint("delay(close, 5)")
    assert formula.fields("if_else(gt(returns, 0), close, open)") == ["close", "open", "returns"]
    assert len(formula.formula_hash("rank(close)")) == 64
    assert delivery_lag("mul(delivery_pct, close)") == "mul(delay(delivery_pct,1),close)"


def test_every_operator_is_queried():
    assert set(OPERATOR_FORMULAS) == set(OPERATORS) and len(OPERATORS) == 35 and len(zoo.ZOO) == 35


def test_duplicates_of_known_formulas():
    assert zoo.zoo_duplicate("mul(ts_rank(rank(low), 9), -1)") == "alpha101_004"
    assert zoo.zoo_duplicate("mul(-1, ts_rank(rank(high), 9))") is None
    assert zoo.zoo_duplicate("mul(-1, ts_rank(rank(high), 9))", 0.85) is None  # another fingerprint
    assert zoo.zoo_duplicate("mul(-1, ts_rank(rank(low), 12))") is None
    assert zoo.zoo_duplicate("mul(-1, ts_rank(rank(low), 12))", 0.85) == "alpha101_004"


def test_structural_keys_replace_numbers_alone():
    assert formula.structural_key("mul(-1.5, ts_mean(close_raw, 21))") == "mul(#,ts_mean(close_raw,#))"


LEAF = st.sampled_from(["close", "open", "volume", "2", "0.5", "-3"])
TREE = st.recursive(LEAF, lambda s: st.tuples(st.sampled_from(["add", "mul", "sub", "div", "min", "eq"]), s, s).map(lambda x: f"{x[0]}({x[1]}, {x[2]})"), max_leaves=8)


@given(TREE)
@settings(max_examples=100, deadline=None)
def test_canonical_form_is_a_fixed_point(f):
    once = formula.canonical(f)
    assert formula.canonical(once) == once


def test_expected_maximum():
    assert [round(expected_max_sharpe(n), 3) for n in (20, 100, 200, 500)] == [1.901, 2.531, 2.766, 3.053]
    assert expected_max_sharpe(1) == 0 and deflated_sharpe(0.0, 100, 0, 3, 0.0) == pytest.approx(0.5)
    assert deflated_sharpe(0.3, 400, 0, 3, 0.1) > deflated_sharpe(0.3, 100, 0, 3, 0.1) > 0.5 and not math.isnan(deflated_sharpe(9, 50, 5, 1, 0))
