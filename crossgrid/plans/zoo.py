"""Known formulas: those published as Alpha101 that the fields allow, and classical anomalies."""

from __future__ import annotations

from difflib import SequenceMatcher

from .formula import canonical, fingerprint

#: Fixed values.
ALPHA101 = {
    "alpha101_002": "mul(-1, correlation(rank(delta(log(volume), 2)), rank(div(sub(close, open), open)), 6))",
    "alpha101_003": "mul(-1, correlation(rank(open), rank(volume), 10))",
    "alpha101_004": "mul(-1, ts_rank(rank(low), 9))",
    "alpha101_005": "mul(rank(sub(open, div(ts_sum(vwap, 10), 10))), mul(-1, abs(rank(sub(close, vwap)))))",
    "alpha101_006": "mul(-1, correlation(open, volume, 10))",
    "alpha101_008": "mul(-1, rank(sub(mul(ts_sum(open, 5), ts_sum(returns, 5)), delay(mul(ts_sum(open, 5), ts_sum(returns, 5)), 10))))",
    "alpha101_012": "mul(sign(delta(volume, 1)), mul(-1, delta(close, 1)))",
    "alpha101_013": "mul(-1, rank(covariance(rank(close), rank(volume), 5)))",
    "alpha101_014": "mul(mul(-1, rank(delta(returns, 3))), correlation(open, volume, 10))",
    "alpha101_016": "mul(-1, rank(covariance(rank(high), rank(volume), 5)))",
    "alpha101_018": "mul(-1, rank(add(add(ts_std(abs(sub(close, open)), 5), sub(close, open)), correlation(close, open, 10))))",
    "alpha101_019": "mul(mul(-1, sign(add(sub(close, delay(close, 7)), delta(close, 7)))), add(1, rank(add(1, ts_sum(returns, 250)))))",
    "alpha101_020": "mul(mul(mul(-1, rank(sub(open, delay(high, 1)))), rank(sub(open, delay(close, 1)))), rank(sub(open, delay(low, 1))))",
    "alpha101_022": "mul(-1, mul(delta(correlation(high, volume, 5), 5), rank(ts_std(close, 20))))",
    "alpha101_026": "mul(-1, ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3))",
    "alpha101_029": "add(min(ts_product(rank(rank(scale(log(ts_sum(ts_min(rank(rank(mul(-1, rank(delta(sub(close, 1), 5))))), 2), 1))))), 1), 5), ts_rank(delay(mul(-1, returns), 6), 5))",
    "alpha101_033": "rank(mul(-1, pow(sub(1, div(open, close)), 1)))",
    "alpha101_034": "rank(add(sub(1, rank(div(ts_std(returns, 2), ts_std(returns, 5)))), sub(1, rank(delta(close, 1)))))",
    "alpha101_035": "mul(mul(ts_rank(volume, 32), sub(1, ts_rank(sub(add(close, high), low), 16))), sub(1, ts_rank(returns, 32)))",
    "alpha101_038": "mul(mul(-1, rank(ts_rank(close, 10))), rank(div(close, open)))",
    "alpha101_040": "mul(mul(-1, rank(ts_std(high, 10))), correlation(high, volume, 10))",
    "alpha101_044": "mul(-1, correlation(high, rank(volume), 5))",
    "alpha101_001": "sub(rank(ts_argmax(signed_power(if_else(lt(returns, 0), ts_std(returns, 20), close), 2), 5)), 0.5)",
    "alpha101_007": "if_else(lt(ts_mean(mul(volume, close), 20), volume), mul(mul(-1, ts_rank(abs(delta(close, 7)), 60)), sign(delta(close, 7))), -1)",
    "alpha101_009": "if_else(lt(0, ts_min(delta(close, 1), 5)), delta(close, 1), if_else(lt(ts_max(delta(close, 1), 5), 0), delta(close, 1), mul(-1, delta(close, 1))))",
}
#: Fixed values.
CLASSICAL = {
    "classical_momentum_12_1": "sub(div(delay(close, 21), delay(close, 252)), 1)",
    "classical_short_term_reversal": "mul(-1, sub(div(close, delay(close, 5)), 1))",
    "classical_low_volatility": "mul(-1, ts_std(returns, 21))",
    "classical_illiquidity_amihud": "ts_mean(div(abs(returns), mul(close, volume)), 21)",
    "classical_lottery_max_ret": "mul(-1, ts_max(returns, 21))",
    "classical_52w_high_proximity": "div(close, ts_max(close, 252))",
    "classical_turnover": "mul(-1, ts_mean(mul(volume, close), 21))",
    "classical_beta": "correlation(returns, sub(returns, demean_cs(returns)), 63)",
    "classical_size": "mul(-1, size_proxy)",
    "classical_volume_shock": "div(volume, ts_mean(volume, 21))",
}
ZOO = ALPHA101 | CLASSICAL


def zoo_duplicate(formula: str, ratio: float = 1.0) -> str | None:
    """The known formula that this one equals in canonical form; with a ratio below 1, else the most similar of those that share its fingerprint, if its text is as similar."""
    own = canonical(formula)
    same = {name: canonical(known) for name, known in ZOO.items() if fingerprint(known) == fingerprint(formula)}
    alike = {name: 1.0 if known == own else SequenceMatcher(None, known, own).ratio() for name, known in same.items()}
    best = max(alike, key=alike.get, default=None)
    return best if best is not None and (same[best] == own or alike[best] >= ratio < 1.0) else None
