"""Universe selection: each month end the most traded names, in force until the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import own_median
from ..sources.staging import staged

WINDOW, HISTORY, TARGET = 63, 126, 200


def candidates(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Month-end rows (date, symbol, tt, hist): median turnover of the last ``window`` own rows and the number of rows so far."""
    own = Window.partitionBy("symbol").orderBy("date")
    d = rows.where("close IS NOT NULL").withColumns({"tt": own_median(F.col("close") * F.col("volume"), window), "hist": F.row_number().over(own)})
    ends = rows.where("close IS NOT NULL").groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
    return d.join(ends, "date").select(F.col("date").alias("month_end"), "symbol", "tt", "hist")


def liquidity_ranks(rows: DataFrame, window: int = WINDOW, history: int = HISTORY) -> DataFrame:
    """month_end, symbol, liquidity_rank (1: most traded, ties by symbol), trailing_turnover."""
    c = candidates(rows, window).where((F.col("hist") >= history) & F.col("tt").isNotNull())
    return c.select("month_end", "symbol", F.row_number().over(Window.partitionBy("month_end").orderBy(F.desc("tt"), "symbol")).cast("long").alias("liquidity_rank"), F.col("tt").alias("trailing_turnover"))


def select(ranks: DataFrame, target: int = TARGET) -> DataFrame:
    return ranks.where(F.col("liquidity_rank") <= target)


def stats(selected: DataFrame, target: int = TARGET) -> DataFrame:
    """month_end, n_members, median_turnover, cutoff (where the selection is full)."""
    return selected.groupBy("month_end").agg(F.count("*").alias("n_members"), F.median("trailing_turnover").alias("median_turnover"), F.when(F.count("*") >= target, F.min("trailing_turnover")).alias("cutoff"))


def membership(selected: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, symbol: members by the last selection strictly before each date; dates before the first one have none."""
    ends = selected.select("month_end").distinct().withColumn("until", F.lead("month_end").over(Window.orderBy("month_end")))
    days = calendar.select("date").distinct().join(ends, (F.col("date") > F.col("month_end")) & (F.col("until").isNull() | (F.col("date") <= F.col("until"))))
    return days.join(selected.select("month_end", "symbol"), "month_end").select("date", "symbol")


def dense_membership(members: DataFrame) -> DataFrame:
    """date, symbol, in_universe over all dates and names that were ever members."""
    grid = members.select("date").distinct().crossJoin(members.select("symbol").distinct())
    return grid.join(members.withColumn("in_universe", F.lit(True)), ["date", "symbol"], "left").withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))


def churn(selected: DataFrame) -> DataFrame:
    """month_end, n_in, n_out, churn: names that came and went since the month before; the first month has none."""
    months = selected.select("month_end").distinct().withColumn("i", F.row_number().over(Window.orderBy("month_end")))
    s = selected.select("month_end", "symbol").join(months, "month_end")
    now, before = s.select("i", "symbol", F.lit(1).alias("here")), s.select((F.col("i") + 1).alias("i"), "symbol", F.lit(1).alias("there"))
    both = now.join(before, ["i", "symbol"], "full_outer").groupBy("i").agg(F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("n_in"), F.sum(F.when(F.col("here").isNull(), 1).otherwise(0)).alias("n_out"), F.count("here").alias("n"))
    return months.where("i > 1").join(both, "i").select("month_end", "n_in", "n_out", (F.col("n_in") / F.col("n")).alias("churn"))


def fringe(ranks: DataFrame, low: int = 150, high: int = 200) -> DataFrame:
    """Names around the cut: ranks low to high, or in months of fewer than ``high`` names the last quarter (half goes to even)."""
    n = F.count("*").over(Window.partitionBy("month_end"))
    return ranks.withColumn("_n", n).where(F.when(F.col("_n") >= high, F.col("liquidity_rank").between(low, high)).otherwise(F.col("liquidity_rank") > F.bround(F.col("_n") * 0.75))).drop("_n")


def intervals(members: DataFrame, gap_days: int = 7) -> DataFrame:
    """symbol, start, end, n: runs of membership without a gap of more than gap_days."""
    w = Window.partitionBy("symbol").orderBy("date")
    new = F.datediff("date", F.lag("date").over(w)) > gap_days
    runs = members.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("symbol", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n")).drop("_run")


def member_runs(selected: DataFrame) -> DataFrame:
    """symbol, after, until: runs of selections, in force on dates later than ``after`` up to ``until`` (null: still in force). A row per run, not per day."""
    ends = selected.select("month_end").distinct()
    w = Window.orderBy("month_end")  # a row per month
    ends = ends.withColumns({"_i": F.row_number().over(w), "_until": F.lead("month_end").over(w)})
    d = selected.select("month_end", "symbol").join(ends, "month_end").withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy("symbol").orderBy("_i")))
    open_ = F.bool_or(F.col("_until").isNull())
    return d.groupBy("symbol", "_run").agg(F.min("month_end").alias("after"), F.when(~open_, F.max("_until")).alias("until")).drop("_run")


def mark_members(rows: DataFrame, runs: DataFrame, out: str = "in_universe") -> DataFrame:
    """The rows and whether their date is in a run of their symbol: an equi-join on symbol and month, of which a run has those that it touches."""
    last = rows.agg(F.max("date").alias("_last"))
    months = F.sequence(F.trunc("after", "month"), F.trunc(F.greatest(F.coalesce("until", "_last"), F.col("after")), "month"), F.expr("INTERVAL 1 MONTH"))
    buckets = runs.crossJoin(last).select(F.col("symbol").alias("_symbol"), "after", "until", F.explode(months).alias("_bucket"))
    on = (F.col("symbol") == F.col("_symbol")) & (F.trunc("date", "month") == F.col("_bucket")) & (F.col("date") > F.col("after")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))
    return rows.join(buckets, on, "left").withColumn(out, F.col("_symbol").isNotNull()).drop("_symbol", "after", "until", "_bucket")


def selection_differences(rows: DataFrame, choose: Callable[[DataFrame], DataFrame], cuts: list) -> DataFrame:
    """cut, side, and the rows that a selection (with month_end) has for months up to a cut from the whole history but not from the history that ends there (side: whole), or the other way round (side: past). A selection that looks ahead has some.

    The whole history's selection is written once; a cut is one aggregate over both sides, each row as often as one has more of it."""
    whole, out = staged(choose(rows)), None
    for cut in cuts:
        end = F.lit(cut).cast("date")
        a, b = whole.where(F.col("month_end") <= end), choose(rows.where(F.col("date") <= end)).where(F.col("month_end") <= end)
        both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
        side = F.explode(F.array_repeat(F.when(F.col("_n") > 0, "whole").otherwise("past"), F.abs("_n").cast("int")))
        d = both.select(end.alias("cut"), side.alias("side"), *a.columns)
        out = d if out is None else out.unionByName(d)
    return out
