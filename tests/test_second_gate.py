"""The second gate: what passes, what is stopped where, and what each call leaves behind."""

import random
from datetime import date, timedelta

import pytest
from crossgrid.config import SPLITS
from crossgrid.plans import backtest, gates, ledger, second_gate
from pyspark.sql import functions as F

Y = "fwd_ret_5_demeaned"
SCHEMA = f"date date, symbol string, pos int, good double, clone double, mirror double, f1 double, noise double, fades double, {Y} double"


@pytest.fixture(scope="module")
def rows(spark):
    r, out = random.Random(2), []
    days = [date(1998, 1, 5) + timedelta(7 * k) for k in range(100)] + [date(2001, 1, 8) + timedelta(7 * k) for k in range(30)]
    for pos, d in enumerate(days):
        for s in range(25):
            y, f1 = r.gauss(0, 1), r.gauss(0, 1)
            late = d.year == 2001
            out.append((d, f"s{s:02}", pos, y + 2 * r.gauss(0, 1) + f1, 2 * f1 - 3, -y + 2 * r.gauss(0, 1), f1, r.gauss(0, 1), (0.0 if late else y) + 1.5 * r.gauss(0, 1), y))
    return spark.createDataFrame(out, SCHEMA).cache()


@pytest.fixture
def logs(spark, tmp_path):
    return ledger.Trials(spark, str(tmp_path / "trials")), ledger.PeekBudget(spark, str(tmp_path / "peeks"), most=1)


def judged(rows, logs, sig, sign=1, **options):
    return second_gate.judge(rows.withColumn("sig", F.col(sig)), second_gate.Card(sig, "t", f"rank(delta(close, {len(sig)}))", sign), ["f1"], *logs, **options)


def test_real_signal_passes_and_spends_one_peek(rows, logs):
    v = judged(rows, logs, "good")
    assert v.passed and v.reasons == [] and v.audit["peek_id"] == 1 and v.audit["holdout_ic"] > 0.1 and v.audit["trial_id"] == 1
    ics = gates.daily_ic(gates.orthogonalize(rows.withColumn("sig", F.col("good")), "sig", ["f1"]).where(backtest.in_split("holdout", SPLITS)), "resid", Y)
    assert v.audit["holdout_ic"] == pytest.approx(ics.agg(F.avg("ic")).first()[0])  # the residual is looked at, not the signal
    trials, peeks = logs
    row = trials.log.read().collect()
    assert len(row) == 1 and row[0].counts_as_trial == 1 and row[0].reason is None and row[0].n_days == 100
    assert peeks.records().first().status == "used"
    again = judged(rows, logs, "good")
    assert again.reasons == ["budget_exhausted"] and peeks.used() == 1 and trials.trials().count() == 2


def test_stops_before_a_peek(rows, logs):
    trials, peeks = logs
    for sig, sign, reasons in (("clone", 1, ["not_novel"]), ("good", -1, ["wrong_sign"]), ("good", 0, ["wrong_sign"])):
        v = judged(rows, logs, sig, sign)
        assert v.reasons == reasons and not v.passed
    weak = judged(rows, logs, "noise", 1 if judged(rows, logs, "noise").reasons != ["wrong_sign"] else -1)
    assert weak.reasons == ["not_novel"] or {"dsr", "t_stat"} <= set(weak.reasons)
    assert peeks.used() == 0 and trials.trials().count() == 5
    assert trials.log.read().where("reason IS NULL").count() == 0


def test_negative_claims_are_scored_as_claimed(rows, logs):
    v = judged(rows, logs, "mirror", -1)
    assert v.audit["marginal_ic"] < 0 and v.audit["t_stat"] > 3 and v.audit["deflated_sharpe"] > 0.95
    assert set(v.reasons) <= {"overfit"}  # scrambles are compared with the signal as it is


def test_collapse_in_the_holdout(rows, logs):
    v = judged(rows, logs, "fades")
    assert not v.passed and v.reasons[0] in ("holdout_sign", "holdout_collapse") and logs[1].used() == 1


def test_many_trials_raise_the_bar(rows, logs):
    trials, _ = logs
    first = judged(rows, (trials, None), "good").audit
    for k in range(4):
        trials.record("other", ("rank(close)", "rank(volume)", "rank(open)", "rank(high)")[k], "val_a", 0.0, 20.0 * (-1) ** k, 100)
    later = judged(rows, (trials, None), "good").audit
    assert later["n_trials_effective"] == 5 and later["expected_max_sr"] > first["expected_max_sr"] and later["deflated_sharpe"] < first["deflated_sharpe"]
    assert "peek_id" not in later


def test_red_team_rows_do_not_count(rows, logs):
    trials, _ = logs
    ics = gates.daily_ic(rows.withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("extra_lag")))), "good", Y, keys=("variant", "date"))
    second_gate.log_redteam(ics, second_gate.Card("good", "t", "rank(close)"), trials)
    found = trials.log.read().orderBy("trial_id").collect()
    assert [(r.trial_id, r.reason, r.counts_as_trial) for r in found] == [(1, "redteam:base", 0), (2, "redteam:extra_lag", 0)]
    assert trials.trials().count() == 0 and trials.pressure("t", "rank(close)")["effective"] == 1


def test_walk_forward_refuses_the_holdout(spark):
    ics = spark.createDataFrame([(date(2000, 5, 1), 0.1)], "date date, ic double")
    with pytest.raises(backtest.HoldoutError):
        gates.walk_forward(ics, gates.folds(spark, "1998-01-01", "2001-03-01", 2, 6), 1)
