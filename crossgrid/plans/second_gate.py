"""The second gate: a signal's residual on the known factors must be novel, of the claimed sign, significant among all trials so far, not overfit, and hold in a holdout that is looked at a counted number of times.

Every call leaves one trial in the ledger, whatever its verdict; runs of the red team leave rows that don't count. The driver handles
a handful of numbers; each step's series is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_NAMES
from ..functions.stats import daily_ic, ic_summary
from ..sources.staging import staged
from . import backtest, gates, loopstate
from .ledger import PeekBudget, Trials


#: Days below which a signal isn't compared with its scrambles.
PBO_DAYS = 40


@dataclass(frozen=True)
class Card:
    """What is claimed before anything is tested."""

    card_id: str
    thesis_id: str
    formula: str
    sign: int = 1
    horizon: int = 5


@dataclass
class Verdict:
    passed: bool
    reasons: list[str]
    audit: dict


def _held(rows: DataFrame, label: str, split: str, least: int) -> dict[str, float | None]:
    """IC of ``resid`` in the holdout, on days of enough names."""
    ics = daily_ic(rows.where(backtest.in_split(split)).where("resid IS NOT NULL"), "resid", label, least=least)
    m = ic_summary(ics).first()
    return {"rank_ic": m.mean_ic if m else None, "t_stat": m.t_stat if m else None, "n_days": m.n_days if m else 0}


def judge(rows: DataFrame, card: Card, factors: list[str], trials: Trials, peeks: PeekBudget | None = None, split: str = "val_a", holdout: str = "holdout", least: int = MIN_NAMES) -> Verdict:
    """rows: labelled, with ``sig`` and the factors. Novelty and sign come first and cost nothing; statistics next, all of them; a peek is spent only on what has passed these. Without ``peeks`` the holdout isn't looked at."""
    label = f"fwd_ret_{card.horizon}_demeaned"
    resid = staged(gates.orthogonalize(rows, "sig", factors).select("date", "symbol", "pos", "sig", "resid", label))
    inside = resid.where(backtest.in_split(split))
    ics = staged(daily_ic(inside, "resid", label, least=least))
    m = ic_summary(ics).first()
    marginal, n_days = (m.mean_ic, m.n_days) if m else (None, 0)
    raw = daily_ic(inside, "sig", label, least=least).agg(F.avg("ic")).first()[0]
    audit: dict = {"split": split, "horizon": card.horizon, "book_size": len(factors), "marginal_ic": marginal, "raw_ic": raw, "realized_sign": None if marginal is None else 1 if marginal > 0 else -1, "n_days": n_days}
    reasons: list[str] = []

    def finish() -> Verdict:
        verdict = Verdict(not reasons, reasons, audit)
        audit["trial_id"] = trials.record(card.thesis_id, card.formula, split, marginal, m.t_stat if m else None, n_days, True, "; ".join(reasons)[:500] or None)
        return verdict

    if marginal is None or abs(marginal) < gates.MIN_MARGINAL_IC:
        reasons.append("not_novel")
        return finish()
    if card.sign == 0 or audit["realized_sign"] != card.sign:
        reasons.append("wrong_sign")
        return finish()
    pressure = trials.pressure(card.thesis_id, card.formula)
    found = gates.dsr(ics.select("date", (F.col("ic") * card.sign).alias("ic")), pressure["effective"], pressure["variance"])
    overfit = loopstate.surrogate_pbo(inside, "resid", label, purge=max(card.horizon, 1), least=least).first()  # of the residual as it is, whatever sign is claimed
    pbo = overfit.pbo if n_days >= PBO_DAYS else None
    t = (m.t_stat or 0.0) * card.sign
    audit |= {"t_stat": t, "deflated_sharpe": found["dsr"], "expected_max_sr": found["benchmark"], "n_trials": pressure["trials"], "n_trials_effective": pressure["effective"], "pbo": pbo, "pbo_n_splits": overfit.n_splits if pbo is not None else 0}
    for failed, reason in ((n_days < gates.MIN_DAYS, "too_short"), (found["dsr"] < gates.MIN_DSR, "dsr"), (abs(t) < gates.MIN_T, "t_stat"), (pbo is not None and pbo > gates.MAX_PBO, "overfit")):
        if failed:
            reasons.append(reason)
    if reasons or peeks is None:
        return finish()
    audit["peek_id"] = peek = peeks.reserve(card.card_id)
    if peek is None:
        reasons.append("budget_exhausted")
        return finish()
    held = _held(resid, label, holdout, least)
    peeks.finish(peek, card.card_id, held)
    audit |= {"holdout_ic": held["rank_ic"], "holdout_t": held["t_stat"]}
    if held["rank_ic"] is None:
        reasons.append("holdout_empty")
    elif (1 if held["rank_ic"] > 0 else -1) != card.sign:
        reasons.append("holdout_sign")
    elif abs(held["rank_ic"]) < gates.MIN_RETENTION * abs(marginal):
        reasons.append("holdout_collapse")
    return finish()


def log_redteam(ics: DataFrame, card: Card, trials: Trials, split: str = "val_a") -> int | None:
    """One row per variant (of variant, date, ic) that doesn't count as a trial: a red team can only reject."""
    from .formula import canonical, formula_hash, structural_key

    each = ic_summary(ics, "variant")
    lit = {"thesis_id": card.thesis_id, "formula_hash": formula_hash(card.formula), "canonical": canonical(card.formula), "shape": structural_key(card.formula), "split": split}
    rows = each.select(*(F.lit(v).alias(k) for k, v in lit.items()), F.col("mean_ic").alias("rank_ic"), F.lit(None).cast("double").alias("sharpe"), "t_stat", "n_days", F.lit(0).alias("counts_as_trial"), F.concat(F.lit("redteam:"), "variant").alias("reason"))
    return trials.record_all(staged(rows))
