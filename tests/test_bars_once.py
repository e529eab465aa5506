"""Queries on line items make their bars once: no result reads the line items again, and no formula or size that isn't used is made."""

import pytest
from crossgrid import registry
from crossgrid.plans import redteam, universe
from crossgrid.sources import panel
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["universe_mask", "selection_check", "redteam_fringe_supplied", "redteam_verdict", "redteam_variants", "case_broken_universe"])
def test_line_items_are_read_once(spark, sf, monkeypatch, name):
    read, seen = panel.read, []
    monkeypatch.setattr(panel, "read", lambda s, d, t: (seen.append(t), read(s, d, t))[1])
    out = registry.queries()[name](spark, sf)
    assert seen.count("lineitem") == 1 and not [f for f in out.inputFiles() if "lineitem" in f]


def test_sizes_are_made_only_for_the_panels_own_ranks(spark):
    rows = spark.createDataFrame([("2000-01-03", "a", 0), ("2000-02-01", "b", 1)], "day string, symbol string, pos int")
    rows = rows.select(F.to_date("day").alias("date"), "symbol", "pos", F.raise_error(F.lit("size")).cast("double").alias("size_proxy"))
    ranks = spark.createDataFrame([("2000-01-03", "a", 1), ("2000-01-03", "b", 2)], "day string, symbol string, liquidity_rank int")
    assert redteam.fringe(rows, ranks.select(F.to_date("day").alias("month_end"), "symbol", "liquidity_rank")).count() == 0  # of two names none is in the last quarter


def test_differences_count_repeated_rows_and_nulls(spark):
    rows = spark.createDataFrame([("2000-01-01", "a"), ("2000-01-01", "a"), ("2000-01-01", None), ("2000-03-01", "b")], "day string, symbol string").select(F.to_date("day").alias("date"), "symbol")

    def choose(d):  # the last date decides how often a row comes, so history's end shows
        late = F.max("date").over(panel.Window.partitionBy())
        n = F.when(late >= "2000-03-01", 1).when(F.col("symbol").isNull(), 1).otherwise(3)
        return d.withColumn("n", n).select(F.col("date").alias("month_end"), "symbol", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("x"))

    got = universe.selection_differences(rows, choose, ["2000-02-01", "2000-04-01"]).collect()
    assert sorted((str(r.cut), r.side, r.symbol) for r in got) == [("2000-02-01", "past", "a")] * 4


@pytest.mark.parametrize("d", [1, 2, 4, 5, 9])
def test_medians_of_few_own_rows(spark, d):
    from statistics import median

    values = [None if k % 13 == 5 else float((k * 7919) % 101) for k in range(60)]
    rows = spark.createDataFrame([(s, k, v) for s in ("a", "b") for k, v in enumerate(values)], "symbol string, date int, x double")
    plan = rows.withColumn("m", panel.own_median(F.col("x"), d))
    assert ("percentile" in plan._jdf.queryExecution().toString()) == (d > 8)
    want = [median(w) if len(w := values[max(k - d + 1, 0) : k + 1]) == d and None not in w else None for k in range(60)]
    for s in ("a", "b"):
        assert [r.m for r in plan.where(F.col("symbol") == s).orderBy("date").collect()] == want
