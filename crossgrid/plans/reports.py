"""Reports over the panel, universe, prices, and state tables, each one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MIN_NAMES
from ..functions import stats
from ..functions.quantiles import quantiles
from ..oracles import sql
from ..sources import panel as source
from ..sources import reports as lines
from ..sources.staging import staged
from ..streaming import trailing
from . import backtest, cards, cases, catalog, loopstate, order, prices, redteam, research, stores, universe
from .queries import FEATURES, LAB, PREPARED, _ready, ic_cte, labelled, query, r, summary
from .formula import evaluate

# universe: supplier x month bars, with windows that fit seven years of months

W, HIST, TOP = 5, 12, 20
RANKS = [
    sql.panel("month", "supplier"),
    f"own AS (SELECT date, symbol, CASE WHEN count(close) OVER w = {W} THEN quantile_cont(close * volume, 0.5) OVER w END AS tt, row_number() OVER (PARTITION BY symbol ORDER BY date) AS hist FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {W - 1} PRECEDING))",
    f"ranks AS (SELECT date AS month_end, symbol, row_number() OVER (PARTITION BY date ORDER BY tt DESC, symbol) AS liquidity_rank, tt AS trailing_turnover FROM own WHERE hist >= {HIST} AND tt IS NOT NULL)",
    f"chosen AS (SELECT * FROM ranks WHERE liquidity_rank <= {TOP})",
]
MEMBERS = [*RANKS, "ends AS (SELECT month_end, lead(month_end) OVER (ORDER BY month_end) AS until FROM (SELECT DISTINCT month_end FROM chosen))", "members AS (SELECT d.date, c.symbol FROM (SELECT DISTINCT date FROM bars) d JOIN ends e ON d.date > e.month_end AND (e.until IS NULL OR d.date <= e.until) JOIN chosen c USING (month_end))"]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.bars(source.trades(spark, sf_dir, "month", "supplier"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.liquidity_ranks(_bars(spark, sf_dir), W, HIST)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return universe.membership(universe.select(universe.liquidity_ranks(bars, W, HIST), TOP), bars)


@query("liquidity_ranks", sql.query(RANKS, "SELECT month_end, symbol, liquidity_rank, round(trailing_turnover, 6) AS trailing_turnover FROM ranks"))
def liquidity_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("trailing_turnover", r("trailing_turnover", 6))


@query("universe_select", sql.query(RANKS, "SELECT month_end, symbol FROM chosen"))
def universe_select(spark, sf_dir):
    return universe.select(_ranks(spark, sf_dir), TOP).select("month_end", "symbol")


@query("universe_stats", sql.query(RANKS, f"SELECT month_end, count(*) AS n_members, round(median(trailing_turnover), 3) AS median_turnover, round(CASE WHEN count(*) >= {TOP} THEN min(trailing_turnover) END, 3) AS cutoff FROM chosen GROUP BY month_end"))
def universe_stats(spark, sf_dir):
    return universe.stats(universe.select(_ranks(spark, sf_dir), TOP), TOP).withColumns({"median_turnover": r("median_turnover", 3), "cutoff": r("cutoff", 3)})


@query("universe_membership", sql.query(MEMBERS, "SELECT * FROM members"))
def universe_membership(spark, sf_dir):
    return _members(spark, sf_dir)


@query("universe_dense", sql.query(MEMBERS, "SELECT d.date, s.symbol, m.symbol IS NOT NULL AS in_universe FROM (SELECT DISTINCT date FROM members) d CROSS JOIN (SELECT DISTINCT symbol FROM members) s LEFT JOIN members m ON m.date = d.date AND m.symbol = s.symbol"))
def universe_dense(spark, sf_dir):
    return universe.dense_membership(_members(spark, sf_dir))


@query("universe_churn", sql.query([*RANKS, "months AS (SELECT month_end, row_number() OVER (ORDER BY month_end) AS i FROM (SELECT DISTINCT month_end FROM chosen))", "n AS (SELECT i, symbol FROM chosen JOIN months USING (month_end))"], "SELECT month_end, (SELECT count(*) FROM n x WHERE x.i = m.i AND x.symbol NOT IN (SELECT symbol FROM n y WHERE y.i = m.i - 1)) AS n_in, (SELECT count(*) FROM n x WHERE x.i = m.i - 1 AND x.symbol NOT IN (SELECT symbol FROM n y WHERE y.i = m.i)) AS n_out, (SELECT count(*) FROM n x WHERE x.i = m.i AND x.symbol NOT IN (SELECT symbol FROM n y WHERE y.i = m.i - 1)) / CAST((SELECT count(*) FROM n x WHERE x.i = m.i) AS DOUBLE) AS churn FROM months m WHERE i > 1"))
def universe_churn(spark, sf_dir):
    return universe.churn(universe.select(_ranks(spark, sf_dir), TOP))


@query("universe_fringe", sql.query(RANKS, "SELECT month_end, symbol, liquidity_rank FROM (SELECT *, count(*) OVER (PARTITION BY month_end) AS n FROM ranks) WHERE CASE WHEN n >= 200 THEN liquidity_rank BETWEEN 150 AND 200 ELSE liquidity_rank > round_even(n * 0.75, 0) END"))
def universe_fringe(spark, sf_dir):
    return universe.fringe(_ranks(spark, sf_dir)).select("month_end", "symbol", "liquidity_rank")


@query("universe_intervals", sql.query([*MEMBERS, "f AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY symbol ORDER BY date) <= 35 THEN 0 ELSE 1 END AS fresh FROM members)", "g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY date) AS run FROM f)"], "SELECT symbol, min(date) AS start, max(date) AS \"end\", count(*) AS n FROM g GROUP BY symbol, run"))
def universe_intervals(spark, sf_dir):
    return universe.intervals(_members(spark, sf_dir), 35)


@query("universe_sector_comp", sql.query([*MEMBERS, "sec AS (SELECT symbol, min(sector) AS sector FROM bars GROUP BY symbol)"], "SELECT date, sector, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY date) AS DOUBLE), 6) AS share FROM members JOIN sec USING (symbol) GROUP BY date, sector"))
def universe_sector_comp(spark, sf_dir):
    sectors = _bars(spark, sf_dir).groupBy("symbol").agg(F.min("sector").alias("sector"))
    counts = _members(spark, sf_dir).join(sectors, "symbol").groupBy("date", "sector").agg(F.count("*").alias("n"))
    return counts.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("date"))))


@query("universe_overlap", sql.query([*RANKS, "months AS (SELECT month_end, row_number() OVER (ORDER BY month_end) AS i FROM (SELECT DISTINCT month_end FROM chosen))", "n AS (SELECT i, symbol FROM chosen JOIN months USING (month_end))"], "SELECT a.i, count(b.symbol) AS shared, round(count(b.symbol) / CAST(count(*) AS DOUBLE), 6) AS overlap FROM n a LEFT JOIN n b ON b.i = a.i - 12 AND b.symbol = a.symbol WHERE a.i > 12 GROUP BY a.i"))
def universe_overlap(spark, sf_dir):
    s = universe.select(_ranks(spark, sf_dir), TOP).select("month_end", "symbol")
    months = s.select("month_end").distinct().withColumn("i", F.row_number().over(Window.orderBy("month_end")))
    n = s.join(months, "month_end").select("i", "symbol")
    then = n.select((F.col("i") + 12).alias("i"), "symbol", F.lit(1).alias("same"))
    return n.where("i > 12").join(then, ["i", "symbol"], "left").groupBy("i").agg(F.count("same").alias("shared"), r(F.count("same") / F.count("*")).alias("overlap"))


@query("universe_daily_coverage", sql.query(MEMBERS, "SELECT date, count(*) AS n_rows, count(m.symbol) AS n_members FROM bars b LEFT JOIN members m USING (date, symbol) GROUP BY date"))
def universe_daily_coverage(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("in_", F.lit(1))
    return _bars(spark, sf_dir).join(m, ["date", "symbol"], "left").groupBy("date").agg(F.count("*").alias("n_rows"), F.count("in_").alias("n_members"))


# prices; actions are drawn from events and orders in a fixed way

SUBJECTS = ("Bonus Issue: Bonus 2:3", "Issue Of BONUS - 5 : 2 Shares", "Fv Split Of Rs. 20 To Rs. 4", "Sub-Division: Re 1 Per Share To Re 0.25", "Interim Dividend Of Rs 7", "Amalgamation With Parent", "Bonus 4:1 And Stock Split Rs 8 To Rs 2", "Extraordinary Meeting", "Rights Issue 5:4")
_SUBJECT_SQL = "CASE CAST(p_partkey % 9 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SUBJECTS)) + " END"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ex_date, subject, type, ratio: one action per part, on a date by its key."""
    part = source.read(spark, sf_dir, "part")
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = part.select("p_partkey", F.col("p_brand").alias("symbol"), F.date_add(F.lit("1995-06-01").cast("date"), (F.col("p_partkey") * 37 % 2300).cast("int")).alias("ex_date"), subject.alias("subject"))
    return rows.withColumn("_a", prices.action(F.col("subject"))).select("p_partkey", "symbol", "ex_date", "subject", "_a.type", "_a.ratio")


_FACTORS = (("bonus", 3 / 5), ("bonus", 2 / 7), ("split", 4 / 20), ("split", 0.25), ("dividend", None), ("demerger", None), ("bonus+split", 1 / 5 * 2 / 8), ("other", None), ("other", None))
ACTIONS = f"actions AS (SELECT p_partkey, p_brand AS symbol, CAST(DATE '1995-06-01' + CAST(p_partkey * 37 % 2300 AS INTEGER) AS DATE) AS ex_date, {_SUBJECT_SQL} AS subject, CASE CAST(p_partkey % 9 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(_FACTORS)) + " END AS type, CASE CAST(p_partkey % 9 AS INTEGER) " + " ".join(f"WHEN {k} THEN CAST({x} AS DOUBLE)" for k, (_, x) in enumerate(_FACTORS) if x) + " END AS ratio FROM part)"


@query("ca_parse", sql.query([ACTIONS], "SELECT p_partkey, symbol, ex_date, subject, type, round(ratio, 6) AS ratio FROM actions"))
def ca_parse(spark, sf_dir):
    return actions(spark, sf_dir).withColumn("ratio", r("ratio"))


@query("ca_counts", sql.query([ACTIONS], "SELECT year(ex_date) AS year, type, count(*) AS n FROM actions GROUP BY 1, 2"))
def ca_counts(spark, sf_dir):
    return actions(spark, sf_dir).groupBy(F.year("ex_date").alias("year"), "type").agg(F.count("*").alias("n"))


ANCHORS = [
    sql.panel(), ACTIONS,
    "d AS (SELECT symbol, date, row_number() OVER w AS rn, close / lag(close) OVER w AS jump FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))",
    "e AS (SELECT symbol, ex_date, product(ratio) AS ratio FROM actions WHERE ratio > 0 AND ratio < 1 GROUP BY 1, 2)",
    "place AS (SELECT e.symbol, ex_date, ratio, min(rn) AS at FROM e JOIN d ON d.symbol = e.symbol AND d.date >= ex_date GROUP BY 1, 2, 3)",
    "anchors AS (SELECT e.symbol, e.ex_date, e.ratio, coalesce((SELECT min(d.date) FROM d JOIN place p ON p.symbol = d.symbol WHERE p.symbol = e.symbol AND p.ex_date = e.ex_date AND abs(d.rn - p.at) <= 3 AND abs(jump / p.ratio - 1) <= 0.2), e.ex_date) AS anchor FROM e)",
]


@query("ca_anchor", sql.query(ANCHORS, "SELECT symbol, ex_date, round(ratio, 6) AS ratio, anchor FROM anchors"))
def ca_anchor(spark, sf_dir):
    return prices.anchors(source.bars(source.trades(spark, sf_dir)), actions(spark, sf_dir)).withColumn("ratio", r("ratio"))


@query("adjust_factor", sql.query(ANCHORS, "SELECT b.date, b.symbol, round(1e6 * coalesce(product(a.ratio), 1), 3) AS factor_ppm FROM bars b LEFT JOIN anchors a ON a.symbol = b.symbol AND a.anchor > b.date GROUP BY 1, 2"))
def adjust_factor(spark, sf_dir):
    bars = source.bars(source.trades(spark, sf_dir))
    return prices.adjust(bars, prices.anchors(bars, actions(spark, sf_dir))).select("date", "symbol", r(F.col("factor") * 1e6, 3).alias("factor_ppm"))


@query("extreme_returns", sql.query([sql.panel(), ACTIONS, "big AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)"], "SELECT symbol, date, round(ret, 6) AS ret, EXISTS (SELECT 1 FROM actions a WHERE a.symbol = big.symbol AND abs(big.date - a.ex_date) <= 3) AS explained FROM big WHERE abs(ret) > 0.5"))
def extreme_returns(spark, sf_dir):
    return prices.extreme_returns(source.bars(source.trades(spark, sf_dir)), actions(spark, sf_dir), 0.5).withColumn("ret", r("ret"))


@query("prices_quality", sql.query([sql.panel()], "SELECT * FROM (SELECT 'close_not_positive' AS \"check\", count(*) FILTER (close <= 0) AS violations FROM bars UNION ALL SELECT 'high_below_low', count(*) FILTER (high < low) FROM bars UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM bars UNION ALL SELECT 'vwap_out_of_range', count(*) FILTER (vwap < low - 1e-9 OR vwap > high + 1e-9) FROM bars UNION ALL SELECT 'null_close', count(*) FILTER (close IS NULL) FROM bars)"))
def prices_quality(spark, sf_dir):
    return prices.quality(source.bars(source.trades(spark, sf_dir)))


@query("prices_coverage_yearly", sql.query([sql.panel()], "SELECT year(date) AS year, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_days FROM bars GROUP BY 1"))
def prices_coverage_yearly(spark, sf_dir):
    return source.bars(source.trades(spark, sf_dir)).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("date").alias("n_days"))


@query("prices_coverage_trend", sql.query([sql.panel(), "c AS (SELECT date, count(*) AS n FROM bars GROUP BY date)"], "SELECT round(regr_slope(n, date_diff('day', DATE '1995-01-01', date)) * 365.25, 6) AS per_year, round(regr_intercept(n, date_diff('day', DATE '1995-01-01', date)), 6) AS at_start FROM c"))
def prices_coverage_trend(spark, sf_dir):
    c = source.bars(source.trades(spark, sf_dir)).groupBy("date").agg(F.count("*").alias("n"))
    day = F.datediff("date", F.lit("1995-01-01").cast("date"))
    return c.agg(r(F.regr_slope("n", day) * 365.25).alias("per_year"), r(F.regr_intercept("n", day)).alias("at_start"))


@query("prices_source_eras", "SELECT l_linestatus AS source, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last, count(*) AS n FROM lineitem GROUP BY 1")
def prices_source_eras(spark, sf_dir):
    day = F.to_date("l_shipdate")
    return source.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("source")).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"))


@query("prices_vwap_sanity", sql.query([sql.panel()], "SELECT year(date) AS year, round(100.0 * avg(CASE WHEN vwap BETWEEN low AND high THEN 1 ELSE 0 END), 6) AS inside_pct, round(100.0 * avg(CASE WHEN vwap > close THEN 1 ELSE 0 END), 6) AS above_close_pct FROM bars GROUP BY 1"))
def prices_vwap_sanity(spark, sf_dir):
    pct = lambda c: r(100 * F.avg(c.cast("double")))
    return source.bars(source.trades(spark, sf_dir)).groupBy(F.year("date").alias("year")).agg(pct(F.col("vwap").between(F.col("low"), F.col("high"))).alias("inside_pct"), pct(F.col("vwap") > F.col("close")).alias("above_close_pct"))


@query("heavyweights", sql.query([sql.panel()], "SELECT symbol, min(date) AS first, max(date) AS last, count(*) AS n_days, round(count(*) / CAST((SELECT count(DISTINCT date) FROM bars) AS DOUBLE), 6) AS share FROM bars WHERE symbol IN ('Brand#11', 'Brand#33', 'Brand#55') GROUP BY symbol"))
def heavyweights(spark, sf_dir):
    bars = source.bars(source.trades(spark, sf_dir))
    days = bars.agg(F.count_distinct("date").alias("all_days"))
    some = bars.where(F.col("symbol").isin("Brand#11", "Brand#33", "Brand#55")).groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_days"))
    return some.crossJoin(days).select("symbol", "first", "last", "n_days", r(F.col("n_days") / F.col("all_days")).alias("share"))


# panel

RAW = ("delivery_pct", "size_proxy")
ALL = (*FEATURES, *RAW)


def _feature_ctes() -> list[str]:
    parts, last = LAB[:2], "lab"
    for k in FEATURES:
        parts.append(sql.formula(FEATURES[k], last, k, f"x_{k}"))
        last = k
    return [*parts, "feats AS (" + " UNION ALL ".join(f"SELECT date, symbol, '{k}' AS feature, {last}.{k} AS v, fwd_ret_5_demeaned AS y FROM {last}" for k in ALL) + ")"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.fwd_labels(source.panel(spark, sf_dir))
    wide = evaluate(rows, FEATURES, ("date", "symbol", "fwd_ret_5_demeaned", *RAW))
    return wide.select("date", "symbol", F.col("fwd_ret_5_demeaned").alias("y"), F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("v")) for k in ALL))).alias("x")).select("date", "symbol", "x.feature", "x.v", "y")


QS = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("panel_feature_stats", sql.query(_feature_ctes(), "SELECT feature, year(date) AS year, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{int(q * 100):02d}" for q in QS) + ", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(v) AS n, count(*) - count(v) AS n_null FROM feats GROUP BY 1, 2"))
def panel_feature_stats(spark, sf_dir):
    rows = staged(_features(spark, sf_dir).select("feature", F.year("date").alias("year"), "v"))
    g = rows.groupBy("feature", "year").agg(r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), F.count("v").alias("n"), (F.count("*") - F.count("v")).alias("n_null"))
    cuts = quantiles(rows, F.col("v"), QS, "feature", "year", written=True).groupBy("feature", "year").agg(*(r(F.max(F.when(F.col("q") == k, F.col("value")))).alias(f"p{int(q * 100):02d}") for k, q in enumerate(QS)))
    return g.join(cuts, ["feature", "year"], "left")


@query("panel_feature_corr", sql.query(_feature_ctes(), "SELECT x.feature AS a, y.feature AS b, round(covar_samp(x.v, y.v) / nullif(stddev_samp(CASE WHEN y.v IS NOT NULL THEN x.v END) * stddev_samp(CASE WHEN x.v IS NOT NULL THEN y.v END), 0), 6) AS corr FROM feats x JOIN feats y USING (date, symbol) WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2"))
def panel_feature_corr(spark, sf_dir):
    """One pass over the wide panel: a conditional correlation per pair."""
    wide = evaluate(source.panel(spark, sf_dir), FEATURES, ("date", "symbol", *RAW))
    pairs = [(a, b) for i, a in enumerate(ALL) for b in ALL[i:]]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    one = wide.agg(*(F.struct(stats.safe_corr(F.when(both[a, b], F.col(a)), F.when(both[a, b], F.col(b))).alias("c"), F.count_if(both[a, b]).alias("n")).alias(f"{a}|{b}") for a, b in pairs))
    cells = [(x, y, a, b) for a, b in pairs for x, y in {(a, b), (b, a)}]
    long = one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`.c").alias("corr"), F.col(f"`{a}|{b}`.n").alias("n")) for x, y, a, b in cells))).alias("x"))
    return summary(long.select("x.a", "x.b", "x.corr", "x.n").where("n > 0").drop("n"))


@query("panel_feature_ic", sql.query([*_feature_ctes(), ic_cte("v", "y", "feats", keys="feature, date", least=MIN_NAMES)], "SELECT feature, year(date) AS year, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ics GROUP BY 1, 2"))
def panel_feature_ic(spark, sf_dir):
    ics = stats.daily_ic(_features(spark, sf_dir), "v", "y", least=MIN_NAMES, keys=("feature", "date"))
    return ics.groupBy("feature", F.year("date").alias("year")).agg(r(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n"))




@query("panel_ic_shift", sql.query([*LAB, "shifts AS (" + " UNION ALL ".join(f"SELECT date, {k} AS shift, lead(sig, {k}) OVER (PARTITION BY symbol ORDER BY pos) AS s, fwd_ret_1 FROM sig" for k in (-1, 0, 1)) + ")", ic_cte("s", "fwd_ret_1", "shifts", keys="shift, date")], "SELECT shift, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ics GROUP BY 1"))
def panel_ic_shift(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    w = source.over_symbol()
    rows = rows.withColumns({f"s{k}": F.lead("sig", k).over(w) for k in (-1, 0, 1)})
    long = rows.select("date", "fwd_ret_1", F.explode(F.array(*(F.struct(F.lit(k).alias("shift"), F.col(f"s{k}").alias("s")) for k in (-1, 0, 1)))).alias("x")).select("date", "fwd_ret_1", "x.shift", "x.s")
    return stats.daily_ic(long, "s", "fwd_ret_1", keys=("shift", "date")).groupBy("shift").agg(r(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n"))


@query("panel_leaky_check", sql.query([*LAB[:2], ic_cte("fwd_ret_1", "fwd_ret_1_demeaned", "lab", out="leaky"), "late AS (SELECT date, lag(fwd_ret_1) OVER (PARTITION BY symbol ORDER BY pos) AS s, fwd_ret_1_demeaned FROM lab)", ic_cte("s", "fwd_ret_1_demeaned", "late", out="lagged")], "SELECT (SELECT round(avg(ic), 6) FROM leaky) AS leaky_ic, (SELECT round(avg(ic), 6) FROM lagged) AS lagged_ic"))
def panel_leaky_check(spark, sf_dir):
    rows = source.fwd_labels(source.panel(spark, sf_dir)).withColumn("late", F.lag("fwd_ret_1").over(source.over_symbol()))
    a = stats.daily_ic(rows, "fwd_ret_1", "fwd_ret_1_demeaned").agg(r(F.avg("ic")).alias("leaky_ic"))
    return a.crossJoin(stats.daily_ic(rows, "late", "fwd_ret_1_demeaned").agg(r(F.avg("ic")).alias("lagged_ic")))


@query("panel_xsec_size", sql.query([sql.panel()], "SELECT date, count(close) AS n FROM panel GROUP BY date"))
def panel_xsec_size(spark, sf_dir):
    return source.panel(spark, sf_dir).groupBy("date").agg(F.count("close").alias("n"))


@query("panel_null_coverage", sql.query(_feature_ctes(), "SELECT feature, date_trunc('month', date)::DATE AS month, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM feats GROUP BY 1, 2"))
def panel_null_coverage(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("feature", F.trunc("date", "month").alias("month")).agg(r(F.avg(F.col("v").isNull().cast("double"))).alias("null_share"))


@query("panel_label_dist", sql.query(LAB[:2], "SELECT CAST(CASE WHEN fwd_ret_5 = 0.3 THEN 59 ELSE floor((fwd_ret_5 + 0.3) / 0.01) END AS INTEGER) AS bin, count(*) AS n FROM lab WHERE fwd_ret_5 BETWEEN -0.3 AND 0.3 GROUP BY 1"))
def panel_label_dist(spark, sf_dir):
    y = F.col("fwd_ret_5")
    return source.fwd_labels(source.panel(spark, sf_dir)).where(y.between(-0.3, 0.3)).groupBy(F.when(y == 0.3, 59).otherwise(F.floor((y + 0.3) / 0.01)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("panel_assertions", sql.query(LAB[:2], f"SELECT (SELECT count(*) FROM (SELECT date FROM panel GROUP BY date HAVING count(close) < {MIN_NAMES})) AS thin_days, (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY date, symbol HAVING count(*) > 1)) AS duplicate_keys, (SELECT round(max(abs(m)), 9) FROM (SELECT avg(fwd_ret_5_demeaned) AS m FROM lab GROUP BY date)) AS demeaned_mean, (SELECT count(*) - count(fwd_ret_5) FROM lab) AS null_labels"))
def panel_assertions(spark, sf_dir):
    rows = source.fwd_labels(source.panel(spark, sf_dir))
    day = rows.groupBy("date").agg((F.count("close") < MIN_NAMES).alias("thin"), F.avg("fwd_ret_5_demeaned").alias("m"))
    a = day.agg(F.count_if("thin").alias("thin_days"), r(F.max(F.abs("m")), 9).alias("demeaned_mean"))
    b = rows.groupBy("date", "symbol").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    return a.crossJoin(b).crossJoin(rows.agg((F.count("*") - F.count("fwd_ret_5")).alias("null_labels")))


_HEAD = ["# Feature panel", "", "Rows are dense over dates and names; a missing value is null."]
_LABELS = {"n": "Rows", "n_names": "Names", "n_days": "Dates", "first": "First", "last": "Last"}


@query("report_features", sql.query([*_feature_ctes(), "one AS (SELECT count(*) AS n, count(DISTINCT symbol) AS n_names, count(DISTINCT date) AS n_days, min(date) AS first, max(date) AS last FROM panel)", "f AS (SELECT feature, count(v) AS n, count(*) - count(v) AS n_null, avg(v) AS mean, min(v) AS low, max(v) AS high FROM feats GROUP BY 1)"],
    "SELECT * FROM (VALUES " + ", ".join(f"(0, {k}::BIGINT, '{line}')" for k, line in enumerate(_HEAD)) + ") t(section, place, line)"
    + "".join(f" UNION ALL SELECT 1, {k}, '- {label}: **' || {c} || '**' FROM one" for k, (c, label) in enumerate(_LABELS.items()))
    + " UNION ALL SELECT 2, 0, '| feature | n | n_null | mean | low | high |' UNION ALL SELECT 2, 1, '|---|---:|---:|---:|---:|---:|' UNION ALL SELECT 2, row_number() OVER (ORDER BY feature) + 1, '| ' || feature || ' | ' || n || ' | ' || n_null || ' | ' || format('{:,.4f}', mean) || ' | ' || format('{:,.4f}', low) || ' | ' || format('{:,.4f}', high) || ' |' FROM f"))
def report_features(spark, sf_dir):
    """The lines of the feature report, by section and place; ``sources.reports`` puts them in order and publishes the file."""
    one = source.panel(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("n_names"), F.count_distinct("date").alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"))
    f = _features(spark, sf_dir).groupBy("feature").agg(F.count("v").alias("n"), (F.count("*") - F.count("v")).alias("n_null"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return lines.text(spark, 0, *_HEAD).unionByName(lines.facts(1, one, _LABELS)).unionByName(lines.table(2, f, ["feature"]))


@query("isin_changes", "SELECT p_name AS name, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def isin_changes(spark, sf_dir):
    return source.read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count_distinct("p_brand").alias("n_brands")).where("n_brands > 1")


for _module in (redteam, research, stores, catalog, loopstate, cards, order, cases, trailing):
    _module.register()
