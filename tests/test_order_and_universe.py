"""Rules of order against a plain loop; membership as runs against a row per day; a selection that looks ahead is found."""

import random
from datetime import date, timedelta

from crossgrid.plans import cases, order, universe
from pyspark.sql import Window
from pyspark.sql import functions as F


def loop(log, rules):
    """Plain Python, event by event."""
    out = []
    for k, (seq, event) in enumerate(log):
        for rule in rules:
            if rule.event != event:
                continue
            past = [e for _, e in log[:k]]
            begin = max((i + 1 for i, e in enumerate(past) if e in rule.since), default=0)
            window = past[begin:]
            if (rule.needs and not any(e in rule.needs for e in window)) or any(e in rule.forbids for e in window):
                out.append((seq, event, rule.name))
                break
    return out


def test_rules_equal_a_plain_loop(spark):
    r, rows = random.Random(4), []
    for key in range(60):
        names = ["preregister", "backtest", "statistics", "peek", "verdict", "generation", "other"]
        rows += [(key, seq, r.choice(names)) for seq in range(r.randint(0, 25))]
    rows += [(99, 0, None), (99, 1, "backtest"), (None, 0, "peek")]
    df = spark.createDataFrame(rows, "thesis long, seq int, event string").repartition(3)
    logs = {}
    for key, seq, event in rows:
        logs.setdefault(key, []).append((seq, event))
    want = {(k, *v) for k, log in logs.items() for v in loop(log, order.RESEARCH)}
    got = order.violations(df, order.RESEARCH, "thesis", ("seq",), first=False).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 60
    first = {x.thesis: (x.seq, x.event, x.rule) for x in order.violations(df, order.RESEARCH, "thesis", ("seq",)).collect()}
    assert first == {k: v[0] for k, log in logs.items() if (v := loop(log, order.RESEARCH))}
    assert order.violations(df.where("false"), order.RESEARCH, "thesis", ("seq",)).count() == 0


def chosen():
    r, ends = random.Random(8), [date(2000, m, 28) for m in range(1, 13)]
    return [(e, f"n{s}") for e in ends for s in range(8) if r.random() < 0.6]


def test_runs_are_the_days(spark):
    selected = spark.createDataFrame(chosen(), "month_end date, symbol string")
    days = [date(1999, 12, 20) + timedelta(k) for k in range(420)]
    grid = spark.createDataFrame([(d, f"n{s}") for d in days for s in range(9)], "date date, symbol string")
    runs = universe.member_runs(selected)
    marked = universe.mark_members(grid, runs)
    got = {(r.date, r.symbol) for r in marked.where("in_universe").collect()}
    want = {(r.date, r.symbol) for r in universe.membership(selected, grid).collect()}
    assert got == want and marked.count() == len(days) * 9 and marked.columns == ["date", "symbol", "in_universe"]
    assert runs.count() < selected.count()
    assert universe.mark_members(grid, runs.where("false")).where("in_universe").count() == 0


def test_survivors_flatter_the_market(spark):
    """Names that fall leave the universe; the last members, applied to all days, never held them."""
    r, rows, selected = random.Random(1), [], []
    for pos in range(36):
        d = date(2000 + pos // 12, pos % 12 + 1, 15)
        for s in range(20):
            price = 100 * (0.97 if s < 10 else 1.01) ** pos * (1 + 0.02 * r.random())
            rows.append((d, f"n{s:02}", pos, price, price))
            if s >= 10 or pos < 18:
                selected.append((d, f"n{s:02}"))
    panel = spark.createDataFrame(rows, "date date, symbol string, pos int, open double, close double")
    got = {x.universe: x for x in cases.broken_universe(panel, spark.createDataFrame(selected, "month_end date, symbol string")).collect()}
    assert got["as_supplied"].market > got["point_in_time"].market + 0.005
    assert got["as_supplied"].n_days == 33 and got["point_in_time"].n_days == 33


def test_looking_ahead_is_found(spark):
    rows = spark.createDataFrame([(date(2000, m, 28), f"n{s}", float((s * m * 7) % 11)) for m in range(1, 13) for s in range(6)], "date date, symbol string, v double")

    def fair(d):
        best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("v"), "symbol"))
        return d.withColumn("k", best).where("k <= 2").select(F.col("date").alias("month_end"), "symbol")

    def ahead(d):
        return fair(d.withColumn("v", F.coalesce(F.lead("v").over(Window.partitionBy("symbol").orderBy("date")), "v")))

    cuts = ["2000-04-28", "2000-09-30"]
    assert universe.selection_differences(rows, fair, cuts).count() == 0
    found = universe.selection_differences(rows, ahead, cuts).collect()
    assert {x.side for x in found} == {"whole", "past"} and {x.month_end for x in found} <= {date(2000, 4, 28), date(2000, 9, 28)} and found


def test_leaks_collapse_when_they_come_late(spark):
    r, rows = random.Random(3), []
    for pos in range(60):
        d = date(1998, 1, 5) + timedelta(7 * pos)
        for s in range(25):
            rows.append((d, f"n{s:02}", pos, 100 + r.gauss(0, 5), 0.05 * r.gauss(0, 1)))
    panel = spark.createDataFrame(rows, "date date, symbol string, pos int, close double, fwd_ret_1_demeaned double")
    got = {x.signal: x for x in cases.leak(panel, "rank(close)").collect()}
    assert got["leak"].mean_ic > 0.9 and abs(got["leak"].lagged_ic) < 0.1 and got["leak"].flagged
    assert abs(got["noise"].mean_ic) < 0.1 and set(got) == {"clean", "leak", "noise"}


def test_signs_against_claims(spark):
    ics = spark.createDataFrame([("a", date(2000, 1, 1), 0.2), ("a", date(2000, 1, 2), -0.1), ("b", date(2000, 1, 1), -0.3), ("c", date(2000, 1, 1), 0.0)], "name string, date date, ic double")
    claims = spark.createDataFrame([("a", 1), ("b", 1), ("c", -1), ("d", 1), ("z", 0)], "name string, claimed int")
    got = {x.name: (x.realized, x.agrees) for x in cases.signs(ics, claims).collect()}
    assert got == {"a": (1, True), "b": (-1, False), "c": (-1, True), "d": (None, False), "z": (None, False)}


def test_pairs_in_one_pass_equal_a_join(spark):
    from crossgrid.plans import gates

    r = random.Random(12)
    rows = [(g, d, n, r.gauss(0, 1)) for g in "xy" for d in range(30) for n in "abc" if r.random() < 0.8] + [("x", 1, "lone", 0.5)]
    df = spark.createDataFrame(rows, "g string, date int, name string, ic double")
    got, want = ({(x.g, x.a, x.b): x.corr for x in gates.pair_corr(df, "date", "name", "ic", names, "g").collect()} for names in (["a", "b", "c", "lone"], None))
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)


def test_overfitting_per_key_is_that_of_each(spark):
    from crossgrid.plans import gates

    r = random.Random(9)
    rows = [(g, t, s, r.gauss(0.02 if s == "a" and g == 1 else 0, 1)) for g in (1, 2) for t in range(40) for s in "abcd"]
    df = spark.createDataFrame(rows, "g int, t long, strategy string, r double")
    got = {x.g: (x.pbo, x.n_splits) for x in gates.pbo(df, keys=("g",)).collect()}
    assert got == {g: tuple(gates.pbo(df.where(F.col("g") == g).drop("g")).first()) for g in (1, 2)}
    picks = gates.drawn(spark.createDataFrame([(f"n{k}",) for k in range(9)], "symbol string"), 4, 3).collect()
    assert len(picks) == 12 and len({(p.draw, p.symbol) for p in picks}) == 12 and len({tuple(sorted(p.symbol for p in picks if p.draw == d)) for d in range(4)}) > 1
