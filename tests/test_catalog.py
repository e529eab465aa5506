import datetime as dt

import pytest
from pyspark.sql import functions as F

from crossgrid.plans import backtest, catalog, prices, redteam
from crossgrid.plans.formula import with_formulas
from crossgrid.plans.queries import labelled
from crossgrid.plans.zoo import ZOO
from crossgrid.sources import panel

D = dt.date


def test_plans_are_as_large_as_their_formulas(spark):
    rows = panel.densify(spark.createDataFrame([(D(2020, 1, 1 + k), s, "x", 1.0 + k) for k in range(5) for s in "AB"], "date date, symbol string, sector string, close double"))

    def size(formula):
        return len(with_formulas(rows, {"v": formula})._jdf.queryExecution().optimizedPlan().toString())

    def nested(n):
        return "close" if not n else f"rank(log({nested(n - 1)}))"

    a, b, c = size(nested(2)), size(nested(4)), size(nested(6))
    assert c - b < 2 * (b - a)
    assert "alpha101_029" in ZOO


def test_nearest_dates_and_snapshots(spark):
    days = spark.createDataFrame([(D(2020, 1, k),) for k in (2, 6, 9)], "date date")
    targets = spark.createDataFrame([(D(2020, 1, k),) for k in (1, 4, 5, 9, 30)], "target date")
    assert {(r.target.day, r.date.day) for r in catalog.nearest(targets, days).collect()} == {(1, 2), (4, 2), (5, 6), (9, 9), (30, 9)}
    snaps = spark.createDataFrame([(D(2020, 1, 1), "A"), (D(2020, 1, 6), "B"), (D(2020, 1, 6), "C")], "effective date, symbol string")
    got = catalog.as_supplied(snaps, days)
    assert {(r.date.day, r.symbol) for r in got.collect()} == {(2, "A"), (6, "B"), (6, "C"), (9, "B"), (9, "C")}
    real = spark.createDataFrame([(D(2020, 1, 9), "A"), (D(2020, 1, 9), "Z"), (D(2020, 1, 2), "Y")], "date date, symbol string")
    r = catalog.reconcile(got, real).first()
    assert (r.real_n, r.supplied_n, r.missing_n, r.missing_pct) == (2, 3, 1, 50.0)


def test_first_known_goes_by_priority(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    one, two = spark.createDataFrame([("a", "x")], "k string, v string"), spark.createDataFrame([("a", "y"), ("b", "z")], "k string, v string")
    got = catalog.first_known(rows, "key", [("one", one), ("two", two)], F.lit("none"), "v")
    assert {(r.key, r.v, r.source) for r in got.collect()} == {("a", "x", "one"), ("b", "z", "two"), ("c", "none", "unknown")}


def test_clean_keeps_the_first_in_order(spark):
    rows = spark.createDataFrame([(D(2020, 1, 1), "A", 1, 5.0, 5.0, 5.0, -1.0, None), (D(2020, 1, 1), "A", 2, 3.0, 3.0, 3.0, 2.0, 9.0), (D(2020, 1, 1), "B", 1, 0.0, 1.0, 1.0, 1.0, 1.0)], "date date, symbol string, n int, close double, high double, low double, volume double, vwap double")
    r = prices.clean(rows, "n").collect()
    assert [(x.symbol, x.close, x.volume, x.vwap) for x in r] == [("A", 5.0, 0.0, 5.0)]


def test_purge_ends_before_the_holdout(spark, sf):
    rows = labelled(spark, sf)
    kept = [r.date for r in backtest.prepare(rows, backtest.Spec("val_b", min_names=1)).select("date").distinct().collect()]
    calendar = sorted(r.date for r in rows.select("date").distinct().collect())
    first = next(i for i, d in enumerate(calendar) if d >= D(2001, 1, 1))
    assert max(calendar.index(d) for d in kept) + 1 + 5 < first
    assert max(kept) == calendar[first - 7]


def test_unknown_falsifications_are_refused(spark, sf):
    with pytest.raises(ValueError):
        redteam.verdict(labelled(spark, sf), spark.createDataFrame([], "date date, bull boolean, bear boolean, calm boolean, volatile boolean, highvol boolean"), asked=("nonsense",))


def test_last_values_and_batches(spark):
    rows = spark.createDataFrame([(k % 2, k) for k in range(30)], "key int, v int")
    assert {r.key: r.last for r in catalog.last_values(rows, "key", "v", ("v",), 3).collect()} == {0: [24, 26, 28], 1: [25, 27, 29]}
    assert [r.n for r in catalog.batches(rows, "v", 4).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [7, 7, 7, 7]


def test_numbers_over_ranges(spark):
    """Places in a full order, and equal batches without a task that sees all rows."""
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id").repartition(7)
    got = catalog.numbered(rows, "k").collect()
    assert sorted((r.k, r._n) for r in got) == [(k, k + 1) for k in range(1000)]
    cut = catalog.batches(rows.where("k < 100"), "k", 8).collect()
    assert sorted((r.k, r.batch) for r in cut) == [(k, k // 12) for k in range(96)]
    assert catalog.numbered(rows.where("false"), "k").count() == 0


def test_paths_end_at_cycles_and_may_be_long(spark):
    from crossgrid.plans import stores

    chain = [(k, k - 1 if k else None) for k in range(150)]
    cards = spark.createDataFrame(chain + [(900, 901), (901, 902), (902, 900), (903, 903)], "card_id long, parent_id long")
    up = stores.lineage(cards)
    assert up.where("card_id = 149").agg({"steps": "max"}).first()[0] == 149
    assert {(r.ancestor, r.steps) for r in up.where("card_id = 900").collect()} == {(900, 0), (901, 1), (902, 2)}
    assert [(r.ancestor, r.steps) for r in up.where("card_id = 903").collect()] == [(903, 0)]


def test_paths_are_no_fewer_than_asked(spark):
    from crossgrid.plans import stores

    n = 100_000
    cards = spark.range(n).select(F.col("id").alias("card_id"), F.when(F.col("id") >= 3, F.floor(F.col("id") / 3).cast("long")).alias("parent_id"))
    got = stores.lineage(cards).agg(F.count("*").alias("n"), F.sum("ancestor").alias("s"), F.max("steps").alias("m")).first()
    want, total, deepest = 0, 0, 0  # more than a million rows
    for k in range(n):
        steps, a = 0, k
        while True:
            want, total, deepest = want + 1, total + a, max(deepest, steps)
            if a < 3:
                break
            steps, a = steps + 1, a // 3
    assert (got.n, got.s, got.m) == (want, total, deepest) and want > 1_000_000


@pytest.mark.parametrize("depth", [None, 0, 1, 3, 4])
def test_paths_of_several_parents(spark, depth):
    from crossgrid.plans import stores

    rows = [(1, None), (2, 1), (3, 2), (3, 1), (4, 3), (4, 3), (5, 4), (6, 7), (7, 8), (8, 6), (9, 7), (10, 77), (None, 1), (11, 11), (12, 5)]
    got = stores.lineage(spark.createDataFrame(rows, "card_id long, parent_id long"), depth).collect()
    want, now = [], [(c, c, 0, (c,)) for c, _ in rows]
    while now:  # step by step
        want += [x[:3] for x in now]
        now = [(c, p, k + 1, (*path, p)) for c, a, k, path in now for card, p in rows if card is not None and card == a and p is not None and (p not in path if depth is None else k < depth)]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.card_id, r.ancestor, r.steps) for r in got), key=key) == sorted(want, key=key)


def test_gaps_are_filled_from_before(spark):
    from crossgrid.sources import synthetic

    rows = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0), ("b", 0, None)], "symbol string, pos int, close double")
    assert {(r.symbol, r.pos): r.close for r in synthetic.forward_filled(rows, "close").collect()} == {("a", 0): None, ("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 5.0, ("b", 0): None}
