"""Falsification: a signal is scored under many variants at once, and flags follow from the scores, all in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZONS, MIN_NAMES
from ..functions import stats
from ..functions.quantiles import quantiles
from ..sources.staging import staged
from . import backtest, universe

#: The menu in its order, and the tests that decide and are always run.
MENU = ("subsample_year", "regime_split", "size_tercile", "cost_sweep", "extra_lag", "delivery_lag", "sector_neutral", "liquidity_filter", "decay_curve", "sign_stability", "universe_edge")
DECISIVE = ("subsample_year", "regime_split", "cost_sweep", "extra_lag", "sign_stability")
COLLAPSE, WEAK_T, REGIME_DAYS, FOLD_DAYS, MODAL_SHARE, COST_BPS, LIQUID = 0.5, 1.5, 60, 40, 0.7, 15.0, 0.4
COSTS = (0.0, 5.0, 15.0, 30.0)
REGIMES = ("bull", "bear", "calm", "volatile", "highvol")
Y = "fwd_ret_5_demeaned"


def governed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """date, month_end: the last month's end before each date of the rows; before the first one, that one. A row per date, in one task."""
    both = rows.select("date", F.lit(True).alias("_own"), F.lit(None).cast("date").alias("_end")).unionByName(ends.select(F.col("month_end").alias("date"), F.lit(False).alias("_own"), F.col("month_end").alias("_end")))
    days = both.groupBy("date").agg(F.max("_own").alias("_own"), F.max("_end").alias("_end"))
    w = Window.orderBy("date")
    end = F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("_end").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return days.withColumn("month_end", end).where("_own AND month_end IS NOT NULL").select("date", "month_end")


def month_ranks(rows: DataFrame) -> DataFrame:
    """month_end, symbol, liquidity_rank by trailing turnover at each month's last date. rows: the dense panel with size_proxy."""
    ends = rows.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("month_end")).select("month_end")
    known = rows.where("size_proxy IS NOT NULL").join(ends, F.col("date") == F.col("month_end"))
    return known.select("month_end", "symbol", F.row_number().over(Window.partitionBy("month_end").orderBy(F.desc("size_proxy"), "symbol")).alias("liquidity_rank"))


def fringe(rows: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """date, symbol, source: names around the universe's cut in the month that governs each date (``universe.fringe``: ranks 150 to 200, or the last quarter of a smaller month).

    ranks: month_end, symbol, liquidity_rank as supplied; they are used if they name any of the panel's symbols, else those of the panel itself (``month_ranks``), whose sizes are made only then; source says which (supplied or panel)."""
    if ranks is not None:
        ranks = staged(ranks.select("month_end", "symbol", "liquidity_rank", F.lit("supplied").alias("source")))
        days, names = staged(rows.select("date").distinct()), staged(rows.select("symbol").distinct())
    if ranks is not None and not names.join(ranks, "symbol", "left_semi").isEmpty():
        given = ranks
    else:
        rows = staged(rows.select("date", "symbol", "size_proxy"))  # ranks, calendar and names are read from it
        given, days, names = month_ranks(rows).withColumn("source", F.lit("panel")), rows, rows.select("symbol").distinct()
    band = universe.fringe(given).select("month_end", "symbol", "source")
    return governed(days, given.select("month_end").distinct()).join(band, "month_end").join(names, "symbol", "left_semi").select("date", "symbol", "source")


def variant_ics(rows: DataFrame, split: str = "val_a", edge: DataFrame | None = None, least: int = MIN_NAMES) -> DataFrame:
    """variant, date, ic: the signal, lagged, sector-neutral, by size tercile, liquid names only, with delivery data a day late (column sig_late, if there) and without the universe's fringe, in one plan. rows: labelled, with sig, sector, size_proxy, turnover_21."""
    rows = rows.withColumn("_lag", F.lag("sig", 1).over(Window.partitionBy("symbol").orderBy("pos"))).where(backtest.in_split(split))
    rows = rows.withColumns({"_size": stats.tercile(F.when(F.col("sig").isNotNull(), F.col("size_proxy")), "date"), "_money": F.exp("turnover_21")})
    # made once: the floor's passes and the variants read them
    rows = staged(rows.select("date", "symbol", "sector", "sig", Y, "_lag", "_size", "_money", *(c for c in ("sig_late",) if c in rows.columns)))
    floor = quantiles(rows, F.col("_money"), (LIQUID,), written=True).agg(F.max("value").alias("_floor"))
    rows = rows.crossJoin(floor)
    sig = F.col("sig")
    variants = {"base": sig, "extra_lag": F.col("_lag"), "sector_neutral": sig - F.avg("sig").over(Window.partitionBy("date", F.coalesce("sector", F.lit("__NA__")))), "liquidity_filter": F.when(F.col("_money") >= F.col("_floor"), sig)}
    variants |= {f"size_{s}": F.when(F.col("_size") == s, sig) for s in ("small", "mid", "large")}
    if "sig_late" in rows.columns:
        variants["delivery_lag"] = F.col("sig_late")
    if edge is not None:
        rows = rows.join(edge.select("date", "symbol", F.lit(True).alias("_edge")), ["date", "symbol"], "left")
        variants["universe_edge"] = F.when(F.col("_edge").isNull(), sig)
    wide = rows.select("date", Y, *(F.round(v, 12).alias(k) for k, v in variants.items()))
    long = wide.select("date", Y, F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(k).alias("s")) for k in variants))).alias("x")).select("date", Y, "x.variant", "x.s")
    enough = F.when(F.col("variant").startswith("size_"), 1).otherwise(least)
    long = long.withColumn("_n", F.count("s").over(Window.partitionBy("variant", "date"))).where(F.col("_n") >= enough)
    return stats.daily_ic(long, "s", Y, keys=("variant", "date"))


def by_year(ics: DataFrame) -> DataFrame:
    return stats.ic_summary(ics.withColumn("year", F.year("date")), "year")


def by_regime(ics: DataFrame, regimes: DataFrame) -> DataFrame:
    """Scores per regime flag; a day counts for each flag that it has."""
    long = regimes.select("date", F.explode(F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in REGIMES)), lambda x: x.isNotNull())).alias("regime"))
    return stats.ic_summary(ics.join(long, "date"), "regime")


def cost_sweep(weights: DataFrame, bps: tuple[float, ...] = COSTS) -> DataFrame:
    """bps and the metrics of the book at that cost; the book's days are made once."""
    daily = backtest.ls_daily(weights).select("date", "gross", "dw", F.explode(F.array(*map(F.lit, bps))).alias("bps"))
    return backtest.ls_metrics(daily.withColumn("net", F.col("gross") - F.col("bps") * 1e-4 * F.col("dw")), "bps")


def scores(ics: DataFrame, regimes: DataFrame) -> DataFrame:
    """kind (variant, year or regime), key, n, s1, s2: counts and sums of ICs, from which means and t follow for any union of keys."""
    flags = regimes.select("date", *(F.col(k).alias(f"_{k}") for k in REGIMES))
    base = F.col("variant") == "base"
    tag = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    tags = [tag("variant", F.col("variant")), F.when(base, tag("year", F.year("date"))), *(F.when(base & F.col(f"_{k}"), tag("regime", F.lit(k))) for k in REGIMES)]
    long = ics.join(flags, "date", "left").select("ic", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("x"))
    return long.groupBy("x.kind", "x.key").agg(F.count("ic").alias("n"), F.sum("ic").alias("s1"), F.sum(F.col("ic") * F.col("ic")).alias("s2"))


def _mean(n: Column, s1: Column) -> Column:
    return F.coalesce(F.try_divide(s1, n), F.lit(0.0))


def _t(n: Column, s1: Column, s2: Column) -> Column:
    m = F.try_divide(s1, n)
    var = F.try_divide(s2 - n * m * m, n - 1)
    return F.coalesce(F.try_divide(m * F.sqrt(n.cast("double")), F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0))


def verdict(rows: DataFrame, regimes: DataFrame, split: str = "val_a", claimed: int = 5, asked: tuple[str, ...] = MENU, edge: DataFrame | None = None, least: int = MIN_NAMES) -> DataFrame:
    """test, flagged, decisive, verdict: each test of the menu, in its order, that is asked for or decisive. A test without its data (sig_late, the fringe) isn't flagged; the signal is killed if a decisive test is."""
    if unknown := set(asked) - set(MENU):
        raise ValueError(f"not on the menu: {sorted(unknown)[0]}")
    found = scores(variant_ics(rows, split, edge, least), regimes)
    pick = lambda kind, key, x: F.max(F.when((F.col("kind") == kind) & (F.col("key") == key), x))
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    names = ("base", "extra_lag", "delivery_lag", "sector_neutral", "liquidity_filter", "universe_edge", "size_small", "size_mid", "size_large")
    one = found.agg(*(F.coalesce(pick("variant", k, _mean(n, s1)), F.lit(0.0)).alias(k) for k in names), *(F.coalesce(pick("variant", k, _t(n, s1, s2)), F.lit(0.0)).alias(f"t_{k}") for k in ("extra_lag", "size_small")), *(F.coalesce(pick("regime", k, x), F.lit(0)).alias(f"{k}_{c}") for k in ("bull", "bear") for c, x in (("n", n.cast("double")), ("ic", _mean(n, s1)))))
    usable = n >= FOLD_DAYS
    best = Window.partitionBy("kind").orderBy(F.when(usable, 0).otherwise(1), F.desc(s1 / n), "key")  # a row per year
    year = found.where("kind = 'year'").withColumn("_k", F.row_number().over(best))
    rest = [F.coalesce(F.sum(F.when(usable & (F.col("_k") > 1), x)), F.lit(0)) for x in (n, s1, s2)]
    years = year.agg(F.count_if(usable).alias("folds"), F.count_if(usable & (s1 > 0)).alias("ups"), F.count_if(usable & (s1 < 0)).alias("downs"), _mean(rest[0], rest[1]).alias("rest"), _t(*rest).alias("t_rest"))
    ready = backtest.prepare(rows, backtest.Spec(split, min_names=least))
    costs = cost_sweep(backtest.book(ready, least), (0.0, COST_BPS)).agg(*(F.max(F.when(F.col("bps") == b, F.col(c))).alias(k) for k, b, c in (("gross", 0.0, "sharpe"), ("net", COST_BPS, "sharpe"), ("net_return", COST_BPS, "ann_return"))))
    curve = backtest.decay(ready, tuple(sorted({*HORIZONS, claimed}))).agg(F.max(F.when(F.col("horizon") == claimed, F.col("mean_ic"))).alias("at_claimed"), F.max("mean_ic").alias("peak"))
    c = F.col
    lost = lambda k: (c(k) <= 0) | ((c("base") > 0) & (c(k) < COLLAPSE * c("base")))
    signs = c("ups") + c("downs")
    flags = {
        "subsample_year": F.when((c("folds") < 3) | (c("base") <= 0), c("base") <= 0).otherwise((((c("rest") < COLLAPSE * c("base")) | (c("rest") <= 0)) & (F.abs("t_rest") < WEAK_T)) | (c("ups") < 0.5 * c("folds"))),
        "regime_split": (c("bull_n") >= REGIME_DAYS) & (c("bear_n") >= REGIME_DAYS) & ((c("bull_ic") <= 0) | (c("bear_ic") <= 0)),
        "size_tercile": (c("size_small") > 0) & (F.abs("t_size_small") >= WEAK_T) & (c("size_large") <= 0) & (c("size_mid") < COLLAPSE * c("size_small")),
        "cost_sweep": c("net").isNull() | (c("net") <= 0) | (c("net_return") <= 0) | ((c("gross") > 0) & (c("net") < COLLAPSE * c("gross")) & (c("net") < 0.5)),
        "extra_lag": lost("extra_lag") | (F.abs("t_extra_lag") < WEAK_T),
        "delivery_lag": lost("delivery_lag") if "sig_late" in rows.columns else F.lit(False),
        "sector_neutral": lost("sector_neutral"),
        "liquidity_filter": lost("liquidity_filter"),
        "decay_curve": c("at_claimed").isNull() | (c("at_claimed") <= 0) | ((c("peak") > 0) & (c("at_claimed") < COLLAPSE * c("peak"))),
        "sign_stability": (signs >= 3) & (F.greatest("ups", "downs") < MODAL_SHARE * signs),
        "universe_edge": lost("universe_edge") if edge is not None else F.lit(False),
    }
    run = [k for k in MENU if k in asked or k in DECISIVE]
    facts = one.crossJoin(years).crossJoin(costs).crossJoin(curve).select(*(F.coalesce(flags[k], F.lit(False)).alias(k) for k in run))
    killed = reduce(lambda a, b: a | b, (c(k) for k in DECISIVE))
    rows_ = F.array(*(F.struct(F.lit(k).alias("test"), c(k).alias("flagged"), F.lit(k in DECISIVE).alias("decisive"), F.when(killed, "killed").otherwise("survives").alias("verdict")) for k in run))
    return facts.select(F.explode(rows_).alias("x")).select("x.*")


def delivery_lag(formula: str, field: str = "delivery_pct") -> str:
    """The formula with one field a day late, to be scored again."""
    from .formula import Node, parse, text

    def late(n: Node) -> Node:
        if n.kind == "field" and n.value == field:
            return Node("op", "delay", (n, Node("const", 1.0)))
        return Node(n.kind, n.value, tuple(map(late, n.args)))

    return text(late(parse(formula)))


#: What the queries test: it leans on delivery data, so that every test has its data; the panel has 25 names, so days of LEAST names count.
TESTED, LEAST = "rank(mul(delivery_pct, mul(-1, delta(close, 5))))", 5


def _facts_sql() -> list[str]:
    """CTEs up to ``flags``, a row of all tests' flags."""
    from ..oracles import sql
    from .queries import TURNOVER, daily_ctes, ic_cte

    train = sql.split("val_a")
    k, n = "rank() OVER (PARTITION BY date ORDER BY sz NULLS LAST) - 1", "count(sz) OVER (PARTITION BY date)"
    variants = {"base": "sig", "extra_lag": "lagged", "sector_neutral": "sig - avg(sig) OVER (PARTITION BY date, coalesce(sector, '__NA__'))", "liquidity_filter": "CASE WHEN money >= p40 THEN sig END", "delivery_lag": "sig_late", "universe_edge": "CASE WHEN NOT edge THEN sig END"}
    variants |= {f"size_{s}": f"CASE WHEN bucket = '{s}' THEN sig END" for s in ("small", "mid", "large")}
    mean, t = "coalesce({s1} / nullif({n}, 0), 0)", "coalesce({s1} / nullif({n}, 0) * sqrt({n}) / nullif(sqrt(greatest(({s2} - {n} * power({s1} / nullif({n}, 0), 2)) / nullif({n} - 1, 0), 0)), 0), 0)"
    cols = {"n": "n", "s1": "s1", "s2": "s2"}
    one = [f"coalesce(max(CASE WHEN kind = 'variant' AND key = '{v}' THEN {mean.format(**cols)} END), 0) AS {v}" for v in variants]
    one += [f"coalesce(max(CASE WHEN kind = 'variant' AND key = '{v}' THEN {t.format(**cols)} END), 0) AS t_{v}" for v in ("extra_lag", "size_small")]
    one += [f"coalesce(max(CASE WHEN kind = 'regime' AND key = '{g}' THEN {x} END), 0) AS {g}_{c}" for g in ("bull", "bear") for c, x in (("n", "n"), ("ic", mean.format(**cols)))]
    rest = {x: f"coalesce(sum(CASE WHEN n >= {FOLD_DAYS} AND k > 1 THEN {x} END), 0)" for x in ("n", "s1", "s2")}
    lost = lambda v: f"({v} <= 0 OR (base > 0 AND {v} < {COLLAPSE} * base))"
    flags = {
        "subsample_year": f"CASE WHEN folds < 3 OR base <= 0 THEN base <= 0 ELSE ((rest < {COLLAPSE} * base OR rest <= 0) AND abs(t_rest) < {WEAK_T}) OR ups < 0.5 * folds END",
        "regime_split": f"bull_n >= {REGIME_DAYS} AND bear_n >= {REGIME_DAYS} AND (bull_ic <= 0 OR bear_ic <= 0)",
        "size_tercile": f"size_small > 0 AND abs(t_size_small) >= {WEAK_T} AND size_large <= 0 AND size_mid < {COLLAPSE} * size_small",
        "cost_sweep": f"net IS NULL OR net <= 0 OR net_return <= 0 OR (gross > 0 AND net < {COLLAPSE} * gross AND net < 0.5)",
        "extra_lag": f"{lost('extra_lag')} OR abs(t_extra_lag) < {WEAK_T}",
        "delivery_lag": lost("delivery_lag"), "sector_neutral": lost("sector_neutral"), "liquidity_filter": lost("liquidity_filter"),
        "decay_curve": f"at_claimed IS NULL OR at_claimed <= 0 OR (peak > 0 AND at_claimed < {COLLAPSE} * peak)",
        "sign_stability": f"ups + downs >= 3 AND greatest(ups, downs) < {MODAL_SHARE} * (ups + downs)",
        "universe_edge": lost("universe_edge"),
    }
    from .queries import REGIMES as REGIME_CTES

    sharpe = "avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252)"
    return [
        sql.panel(), sql.labels(), sql.formula(TESTED, "lab"), sql.formula(TURNOVER, "sig", "turnover_21", "t"), sql.formula(delivery_lag(TESTED), "turnover_21", "sig_late", "d"), *REGIME_CTES,
        "v0 AS (SELECT *, lag(sig, 1) OVER (PARTITION BY symbol ORDER BY pos) AS lagged, exp(turnover_21) AS money, CASE WHEN sig IS NOT NULL THEN size_proxy END AS sz FROM sig_late)",
        f"v1 AS (SELECT *, CASE WHEN sz IS NULL OR {n} < 3 THEN NULL WHEN 3 * ({k}) <= {n} - 1 THEN 'small' WHEN 3 * ({k}) <= 2 * ({n} - 1) THEN 'mid' ELSE 'large' END AS bucket FROM v0 WHERE {train})",
        f"p AS (SELECT quantile_cont(money, {LIQUID}) AS p40 FROM v1)",
        "ends AS (SELECT max(date) AS d FROM panel GROUP BY date_trunc('month', date))",
        "ranked AS (SELECT DISTINCT date AS d FROM panel JOIN ends ON date = d WHERE size_proxy IS NOT NULL)",
        "dayend AS (SELECT date, coalesce((SELECT max(d) FROM ranked WHERE d < date), (SELECT min(d) FROM ranked)) AS d FROM (SELECT DISTINCT date FROM panel))",
        "band AS (SELECT date AS d, symbol FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY size_proxy DESC, symbol) AS k, count(*) OVER (PARTITION BY date) AS n FROM panel JOIN ends ON date = d WHERE size_proxy IS NOT NULL) WHERE CASE WHEN n >= 200 THEN k BETWEEN 150 AND 200 ELSE k > round_even(n * 150 / 200.0, 0) END)",
        "v2 AS (SELECT v1.*, p40, band.symbol IS NOT NULL AS edge FROM v1 CROSS JOIN p JOIN dayend USING (date) LEFT JOIN band ON band.d = dayend.d AND band.symbol = v1.symbol)",
        "vlong AS (" + " UNION ALL ".join(f"SELECT date, {Y}, '{name}' AS variant, round({x}, 12) AS s FROM v2" for name, x in variants.items()) + ")",
        f"vkept AS (SELECT * FROM (SELECT *, count(s) OVER (PARTITION BY variant, date) AS m FROM vlong) WHERE m >= CASE WHEN variant LIKE 'size%' THEN 1 ELSE {LEAST} END)",
        ic_cte("s", Y, "vkept", keys="variant, date", out="vics"),
        "tags AS (SELECT 'variant' AS kind, variant AS key, ic FROM vics UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), ic FROM vics WHERE variant = 'base' UNION ALL " + " UNION ALL ".join(f"SELECT 'regime', '{g}', ic FROM vics JOIN regimes USING (date) WHERE variant = 'base' AND {g}" for g in REGIMES) + ")",
        "found AS (SELECT kind, key, count(*) AS n, sum(ic) AS s1, sum(ic * ic) AS s2 FROM tags GROUP BY 1, 2)",
        f"one AS (SELECT {', '.join(one)} FROM found)",
        f"yr AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n >= {FOLD_DAYS} THEN 0 ELSE 1 END, s1 / n DESC, key) AS k FROM found WHERE kind = 'year')",
        f"years AS (SELECT count(*) FILTER (n >= {FOLD_DAYS}) AS folds, count(*) FILTER (n >= {FOLD_DAYS} AND s1 > 0) AS ups, count(*) FILTER (n >= {FOLD_DAYS} AND s1 < 0) AS downs, {mean.format(**rest)} AS rest, {t.format(**rest)} AS t_rest FROM yr)",
        f"kept AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM sig WHERE sig IS NOT NULL AND {train})",
        f"ready AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE 2.0 * (({sql.average_rank('round(sig, 12)')}) - 1) / (n - 1) - 1 END AS scaled FROM kept WHERE n >= {LEAST})",
        *(x.replace(f"m >= {MIN_NAMES}", f"m >= {LEAST}") for x in daily_ctes(0.0)),
        f"money AS (SELECT {sharpe.format(x='gross')} AS gross, {sharpe.format(x=f'(gross - {COST_BPS} * 1e-4 * dw)')} AS net, avg(gross - {COST_BPS} * 1e-4 * dw) * 252 AS net_return FROM daily)",
        "hlong AS (" + " UNION ALL ".join(f"SELECT date, scaled, {h} AS horizon, fwd_ret_{h}_demeaned AS y FROM ready" for h in HORIZONS) + ")",
        ic_cte("scaled", "y", "hlong", keys="horizon, date", out="hics"),
        "curve AS (SELECT max(CASE WHEN horizon = 5 THEN m END) AS at_claimed, max(m) AS peak FROM (SELECT horizon, avg(ic) AS m FROM hics GROUP BY 1))",
        "flags AS (SELECT " + ", ".join(f"coalesce({x}, false) AS f_{name}" for name, x in flags.items()) + " FROM one CROSS JOIN years CROSS JOIN money CROSS JOIN curve)",
    ]


def register() -> None:
    from ..oracles import sql
    from ..sources import panel as source
    from .formula import with_formulas
    from .reports import RANKS
    from .reports import HIST, W, _bars
    from .queries import IC_SUMMARY, LAB, PREPARED, TURNOVER, daily_ctes, ic_cte, labelled, query, r, regime_labels, summary
    from .queries import REGIMES as REGIME_CTES

    def base(spark, sf_dir):
        ready = backtest.prepare(labelled(spark, sf_dir), backtest.Spec())
        return stats.daily_ic(ready, "scaled", Y)

    @query("redteam_years", sql.query([*PREPARED, ic_cte()], f"SELECT year(date) AS year, {IC_SUMMARY} FROM ics GROUP BY 1"))
    def redteam_years(spark, sf_dir):
        return summary(by_year(base(spark, sf_dir)))

    tagged = "tagged AS (" + " UNION ALL ".join(f"SELECT ics.*, '{k}' AS regime FROM ics JOIN regimes USING (date) WHERE {k}" for k in REGIMES) + ")"

    @query("redteam_regimes", sql.query([*PREPARED, ic_cte(), *REGIME_CTES, tagged], f"SELECT regime, {IC_SUMMARY} FROM tagged GROUP BY 1"))
    def redteam_regimes(spark, sf_dir):
        return summary(by_regime(base(spark, sf_dir), regime_labels(spark, sf_dir)))

    sweep = " UNION ALL ".join(f"SELECT {c} AS bps, date, gross - {c} * 1e-4 * dw AS net, dw FROM daily" for c in COSTS)

    @query("redteam_costs", sql.query([*PREPARED, *daily_ctes(0.0), f"sweep AS ({sweep})"], "SELECT CAST(bps AS DOUBLE) AS bps, round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(avg(net) * 252, 6) AS ann_return, round(avg(dw) / 2, 6) AS turnover FROM sweep GROUP BY 1"))
    def redteam_costs(spark, sf_dir):
        out = cost_sweep(backtest.book(backtest.prepare(labelled(spark, sf_dir), backtest.Spec())))
        return out.select("bps", r("sharpe", 4).alias("sharpe"), r("ann_return").alias("ann_return"), r("turnover").alias("turnover"))

    def tested(spark, sf_dir):
        """The panel and what is tested on it; the line items are read once, for bars that are written."""
        rows = source.panel_of(staged(source.bars(source.trades(spark, sf_dir))))
        return rows, with_formulas(source.fwd_labels(rows), {"sig": TESTED, "turnover_21": TURNOVER, "sig_late": delivery_lag(TESTED)})

    facts = _facts_sql()

    @query("redteam_variants", sql.query(facts, f"SELECT variant, {IC_SUMMARY.replace('stddev_samp(ic)', 'nullif(stddev_samp(ic), 0)')} FROM vics GROUP BY 1"))
    def redteam_variants(spark, sf_dir):
        rows, signals = tested(spark, sf_dir)
        return summary(stats.ic_summary(variant_ics(signals, edge=fringe(rows), least=LEAST), "variant"))

    killed = " OR ".join(f"f_{k}" for k in DECISIVE)

    @query("redteam_verdict", sql.query(facts, "SELECT t.test, t.flagged, t.decisive, verdict FROM (SELECT " + f"CASE WHEN {killed} THEN 'killed' ELSE 'survives' END AS verdict, unnest([" + ", ".join(f"{{'test': '{k}', 'flagged': f_{k}, 'decisive': {str(k in DECISIVE).lower()}}}" for k in MENU) + "]) AS t FROM flags)"))
    def redteam_verdict(spark, sf_dir):
        rows, signals = tested(spark, sf_dir)
        return verdict(signals, backtest.regime_labels(source.fwd_labels(rows)), edge=fringe(rows), least=LEAST)

    @query("redteam_fringe", sql.query([facts[0], *(c for c in facts if c.startswith(("ends AS", "ranked AS", "dayend AS", "band AS")))], "SELECT date, symbol, 'panel' AS source FROM dayend JOIN band USING (d)"))
    def redteam_fringe(spark, sf_dir):
        return fringe(source.panel(spark, sf_dir))

    bounds = "SELECT date, coalesce((SELECT max(month_end) FROM {0} WHERE month_end < date), (SELECT min(month_end) FROM {0})) AS month_end FROM (SELECT DISTINCT date FROM panel)"
    cut = "SELECT month_end, symbol FROM (SELECT *, count(*) OVER (PARTITION BY month_end) AS n FROM ranks) WHERE CASE WHEN n >= 200 THEN liquidity_rank BETWEEN 150 AND 200 ELSE liquidity_rank > round_even(n * 0.75, 0) END"

    @query("redteam_fringe_supplied", sql.query([*RANKS, f"cut AS ({cut})", f"gov AS ({bounds.format('ranks')})"], "SELECT date, symbol, 'supplied' AS source FROM gov JOIN cut USING (month_end) WHERE symbol IN (SELECT symbol FROM panel)"))
    def redteam_fringe_supplied(spark, sf_dir):
        bars = staged(_bars(spark, sf_dir).select("date", "symbol", "sector", "close", "volume"))
        return fringe(source.panel_of(bars), universe.liquidity_ranks(bars, W, HIST))

    late = delivery_lag("rank(mul(delivery_pct, delta(close, 5)))")

    @query("redteam_delivery_lag", sql.query([*LAB[:2], sql.formula(late, "lab"), ic_cte("sig", Y, "sig", least=MIN_NAMES)], f"SELECT {IC_SUMMARY} FROM ics WHERE {sql.split('val_a')}"))
    def redteam_delivery_lag(spark, sf_dir):
        ics = stats.daily_ic(labelled(spark, sf_dir, late), "sig", Y, least=MIN_NAMES)
        return summary(stats.ic_summary(ics.where(backtest.in_split("val_a"))))
