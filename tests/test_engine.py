import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrid import contracts
from crossgrid.config import SPLITS
from crossgrid.functions import stats
from crossgrid.plans import backtest, gates, prices, queries, reports, stores, universe
from crossgrid.sources import files, panel as source, synthetic

D = dt.date


def test_planted_signal_is_found(spark):
    rows = synthetic.planted(spark, 400, 60).cache()
    ic = {k: stats.ic_summary(stats.daily_ic(rows, k, "fwd_ret_1_demeaned")).first() for k in ("planted", "noise", "leak")}
    assert abs(ic["planted"].mean_ic - 0.04) < 0.02 and ic["planted"].t_stat > 3
    assert abs(ic["noise"].t_stat) < 3 and ic["leak"].mean_ic > 0.99
    neg = stats.ic_summary(stats.daily_ic(rows.withColumn("n", -F.col("planted")), "n", "fwd_ret_1_demeaned")).first()
    assert neg.mean_ic == pytest.approx(-ic["planted"].mean_ic) and neg.sign == -1
    late = backtest.shift_signal(rows.withColumn("sig", F.col("leak")), 1)
    assert abs(stats.ic_summary(stats.daily_ic(late, "sig", "fwd_ret_1_demeaned")).first().mean_ic) < 0.05


def test_costs_lower_the_sharpe_ratio(spark):
    rows = synthetic.planted(spark, 200, 40, ic=0.3).withColumn("scaled", stats.rank_scale(F.col("planted"), "date"))
    w = backtest.book(rows)
    assert w.groupBy("date").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).where("abs(net) > 1e-9 or abs(gross - 2) > 1e-9").count() == 0
    sharpe = [backtest.ls_metrics(backtest.ls_daily(w, c)).first().sharpe for c in (0.0, 10.0, 40.0)]
    assert sharpe[0] > sharpe[1] > sharpe[2] and sharpe[0] > 0


def test_turnover_is_that_of_the_grid(spark):
    rows = [(D(2020, 1, 1), "A", 0.5, 0.0), (D(2020, 1, 1), "B", -0.5, 0.0), (D(2020, 1, 2), "B", -0.25, 0.0), (D(2020, 1, 2), "C", 0.25, 0.0)]
    got = backtest.ls_daily(spark.createDataFrame(rows, "date date, symbol string, w double, fwd_ret_1 double")).orderBy("date").collect()
    assert [r.dw for r in got] == pytest.approx([1.0, 1.0])


def test_holdout_needs_a_token():
    with pytest.raises(backtest.HoldoutError):
        backtest.guard("val_a+holdout")
    backtest.guard("holdout", token=True)
    backtest.guard("train+val_a")
    with pytest.raises(ValueError):
        SPLITS.parts("nothing")
    with pytest.raises(ValueError):
        backtest.subsampled(None, {"moon": 1}, None)


def test_purge(spark):
    days = spark.range(60).select(F.col("id").cast("int").alias("pos"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    got = {r.pos: r.state for r in backtest.purge_embargo(days, F.col("pos").between(20, 29), 5, 3).collect()}
    assert [p for p, s in got.items() if s == "purged"].__len__() == 6 and {p for p, s in got.items() if s == "embargoed"} == {30, 31, 32}


def test_regimes_do_not_see_the_future(spark):
    rows = synthetic.planted(spark, 200, 5)
    a = {r.date: r for r in backtest.regime_labels(rows).collect()}
    b = backtest.regime_labels(rows.where("pos < 150")).collect()
    assert len(b) == 150 and all(a[r.date] == r for r in b)


def test_residuals(spark):
    rows = synthetic.planted(spark, 30, 20).select("date", "symbol", F.col("planted").alias("y"), F.col("noise").alias("a"), (F.col("noise") * 0.3 + F.col("leak")).alias("b"))
    r = gates.orthogonalize(rows, "y", ["a", "b"]).groupBy("date").agg(F.covar_samp("resid", "a").alias("ca"), F.covar_samp("resid", "b").alias("cb"), F.avg("resid").alias("m"))
    assert r.where("abs(ca) > 1e-9 or abs(cb) > 1e-9 or abs(m) > 1e-9").count() == 0
    same = gates.orthogonalize(rows, "y", ["y"]).agg(F.max(F.abs("resid"))).first()[0]
    assert same < 1e-9


def test_overfitting_probability(spark):
    noise = spark.range(400 * 12).select((F.col("id") % 400).alias("t"), F.floor(F.col("id") / 400).cast("string").alias("strategy"), synthetic.normal(3, "id").alias("r"))
    p = gates.pbo(noise).first()
    assert p.n_splits == 70 and 0.1 < p.pbo < 0.9
    real = noise.withColumn("r", F.col("r") + F.when(F.col("strategy") == "4", 0.5).otherwise(0.0))
    assert gates.pbo(real).first().pbo < 0.1


def test_effective_counts(spark):
    one = spark.createDataFrame([(a, b, 1.0) for a in "xyz" for b in "xyz"], "a string, b string, corr double")
    assert gates.participation(one).first().effective_n == pytest.approx(1)
    keys = spark.createDataFrame([(k, "c") for k in "xyz"], "name string, cluster string")
    assert gates.effective_trials(keys, one).first().effective_trials == pytest.approx(1)


SUBJECTS = [
    ("Bonus 3:2", "bonus", 0.4), ("Issue Of Bonus- 1:4", "bonus", 0.8), ("bonus : 5 : 1", "bonus", 1 / 6), ("FACE VALUE Split Rs.20/- To Rs.4/-", "split", 0.2), ("Fv Splt Rs 8 To Re 1", "split", 0.125),
    ("F. V. Split Of Rs 6 Per Share To Rs 3", "split", 0.5), ("Subdivision Re 1 To Re 0.25", "split", 0.25), ("Split Of Rs 4 To Rs 8", "other", None), ("Final Dividend Rs 12", "dividend", None), ("Rights 7:3", "other", None),
    ("Amalgamation", "demerger", None), ("Bonus 2:1 On Demerger", "demerger", None), ("Bonus 3:1 And Split From Rs 4 To Rs 2", "bonus+split", 0.125), (None, "other", None), ("", "other", None),
]


def test_action_texts(spark):
    got = spark.createDataFrame([(s,) for s, _, _ in SUBJECTS], "s string").select(prices.action(F.col("s")).alias("a")).collect()
    for (s, kind, ratio), r in zip(SUBJECTS, got):
        assert r.a.type == kind, s
        assert r.a.ratio == (pytest.approx(ratio) if ratio else None), s


def test_adjustment_ends_at_the_observed_break(spark):
    close = [100.0, 101.0, 102.0, 51.0, 52.0, 53.0]
    rows = spark.createDataFrame([(D(2020, 1, 1 + k), "A", c, 10.0) for k, c in enumerate(close)], "date date, symbol string, close double, volume double")
    events = spark.createDataFrame([("A", D(2020, 1, 3), 0.5)], "symbol string, ex_date date, ratio double")
    anchored = prices.anchors(rows, events)
    assert anchored.first().anchor == D(2020, 1, 4)
    got = [r.close_adj for r in prices.adjust(rows, anchored).orderBy("date").collect()]
    assert got == pytest.approx([50, 50.5, 51, 51, 52, 53])


def test_selection_ignores_the_future(spark):
    rows = synthetic.ohlcv(spark, 400, 12)
    full = universe.liquidity_ranks(rows, 20, 40)
    cut = universe.liquidity_ranks(rows.where("date <= DATE '1996-08-31'"), 20, 40)
    past = full.where("month_end <= DATE '1996-08-31'")
    assert cut.count() > 0 and cut.exceptAll(past).count() == 0 and past.exceptAll(cut).count() == 0
    members = universe.membership(universe.select(full, 5), rows)
    assert members.groupBy("date").count().where("count > 5").count() == 0


def test_contract(spark):
    good = synthetic.ohlcv(spark, 60, 5).select("date", "symbol", "open", "high", "low", "close", "volume", F.col("close").alias("close_raw"), F.col("volume").alias("volume_raw"), "vwap", "n_trades", F.lit("i").alias("isin"), F.lit("x").alias("source"), F.lit("EQ").alias("series"))
    assert contracts.validate(good, contracts.OHLCV) == []
    assert contracts.validate(good.drop("vwap"), contracts.OHLCV)
    assert contracts.validate(good.withColumn("vwap", F.col("high") * 2), contracts.OHLCV) == [f"vwap_inside: {good.count()} rows"]
    assert "keys" in contracts.validate(good.unionByName(good.limit(1)), contracts.OHLCV)[0]


def test_state_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 7.0), ("b", 2, 1.0)], "k string, seq int, v double")
    assert {(r.k, r.v) for r in stores.latest(rows, "k", "seq").collect()} == {("a", 7.0), ("b", 1.0)}
    helped = [1.0, 0.0, 0.0, 1.0, 0.0]
    p = helped[0]
    for h in helped[1:]:
        p = 0.5 * h + 0.5 * p
    got = stores.lessons(spark.createDataFrame([("m", k, h, True) for k, h in enumerate(helped)], "motif string, seq int, helped double, confident boolean")).first()
    assert got.p_helps == pytest.approx(p) and got.veto and got.n_failures == 3
    budget = stores.PeekBudget(spark, str(tmp_path / "peeks"), 2)
    assert [budget.reserve("x") for _ in range(3)] == [1, 2, None]
    share = stores.allocation(spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0)], "family string, reward double")).collect()
    assert sum(r.share for r in share) == pytest.approx(1) and min(r.share for r in share) >= 0.05
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "card_id long, parent_id long")
    assert stores.lineage(cycle, 5).count() == 12


def test_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "SYMBOL , CLOSE\nA, 1.5\nB,-\n")
    got = files.numeric(files.by_name(files.read_zipped_csv(spark, str(tmp_path / "d.zip")), "SYMBOL", "CLOSE"), "CLOSE").collect()
    assert [(r.SYMBOL, r.CLOSE) for r in got] == [("A", 1.5), ("B", None)]
    (tmp_path / "m.csv").write_text("SYMBOL, CLOSE\nA, 2.5\nB, -\n")
    assert [r.CLOSE for r in files.read_modern_csv(spark, str(tmp_path / "m.csv")).collect()] == ["2.5", None]
    rows = spark.createDataFrame([("f1", 1.0), ("f2", 2.0)], "factor string, value double")
    files.replace_factor(spark, str(tmp_path / "book"), rows)
    files.replace_factor(spark, str(tmp_path / "book"), spark.createDataFrame([("f2", 9.0)], "factor string, value double"))
    assert {(r.factor, r.value) for r in spark.read.parquet(str(tmp_path / "book")).collect()} == {("f1", 1.0), ("f2", 9.0)}
    assert files.write_cache(rows, str(tmp_path / "c"), {"factor": "string"}, ["x"])["status"] == "ok"
    with pytest.raises(ValueError):
        files.guarded_scan(spark, str(tmp_path / "book"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130


def test_prefilter():
    from crossgrid.plans import research

    deep = "close"
    for _ in range(15):
        deep = f"abs({deep})"
    assert [research.prefilter(f, {"rank(open)"}) for f in ("close.x", deep, "mul(-1, ts_rank(rank(low), 9))", "rank(open)", "rank(volume)")] == ["parse_error", "too_complex", "known_formula", "repeated", None]
    assert research.prefilter("ts_mean(close)", set()) == "eval_error"
    assert research.preregister({"a": 1, "b": 2}) == research.preregister({"b": 2, "a": 1})
    assert [research.stage(g) for g in (0, 2, 3, 12)] == [0, 0, 1, 0] and research.tightened(0.4, 3.0, 0.01) == (3.5, 0.015)
    assert research.exhausted([0.1, 0.1, 0.1, 0.1]) and not research.exhausted([0.1, 0.1, 0.1, 0.2])


def test_ablation(spark, sf):
    import __spark_entry__ as entry

    got = {r.signal_id: r for r in entry.queries()["ablation_scores"](spark, sf.replace("sf0.001", "sf0.01")).collect()}
    assert got["leaky"].ic > 0.7 and not got["leaky"].redteam and abs(got["noise"].t) < 4 and got["genuine"].ic > 0.1
    events = spark.createDataFrame([("a", 1, "novelty"), ("a", 2, "statistics"), ("b", 1, "statistics")], "thesis_id string, seq int, event string")
    from crossgrid.plans import research

    assert [r.thesis_id for r in research.ordered_events(events, "novelty", "statistics").collect()] == ["b"]


def _plain_pbo(r, n_blocks=8):
    """Of a matrix of returns (time by strategy), as the reference does it: whole blocks, the remainder dropped."""
    q = len(r) // n_blocks
    sr = lambda a: np.nan_to_num(a.mean(0) / np.where((s := a.std(0, ddof=1)) > 1e-12, s, np.nan))
    below = []
    for c in itertools.combinations(range(n_blocks), n_blocks // 2):
        inside = np.isin(np.arange(q * n_blocks) // q, c)
        a, b = sr(r[: q * n_blocks][inside]), sr(r[: q * n_blocks][~inside])
        best = np.flatnonzero(a == a.max())[-1]
        w = ((b < b[best]).sum() + ((b == b[best]).sum() + 1) / 2) / (r.shape[1] + 1)
        below.append(w < 0.5)
    return sum(below) / len(below)


def test_overfitting_probability_drops_the_remainder_only(spark):
    for t in (403, 356, 39):
        r = np.random.default_rng(t).normal(size=(t, 12))
        rows = spark.createDataFrame([(i, f"{k:02d}", float(r[i, k])) for i in range(t) for k in range(12)], "t long, strategy string, r double")
        assert gates.pbo(rows).first().pbo == pytest.approx(_plain_pbo(r))


def test_overfitting_query_takes_all_weeks(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(gates, "pbo", lambda rows: seen.append(rows) or rows.agg(F.lit(0.5).alias("pbo"), F.lit(70).alias("n_splits")))
    queries.cscv_pbo(spark, sf)
    want = source.panel(spark, sf).agg(F.max("pos")).first()[0]
    got = seen[0].agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count_distinct("t").alias("n")).first()
    assert (got.low, got.high, got.n) == (0, want - 1, want) and want > 320


def test_actions_come_from_all_parts(spark, sf):
    keys = lambda d: sorted(r[0] for r in d.select("p_partkey").collect())
    parts = keys(source.read(spark, sf, "part"))
    assert keys(reports.actions(spark, sf)) == parts == keys(reports.ca_parse(spark, sf))
    assert reports.ca_counts(spark, sf).agg(F.sum("n")).first()[0] == len(parts)
