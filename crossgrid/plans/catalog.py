"""Lookups, scans by era, snapshots, and synthetic candidates: the smaller operators that other plans are made of, each with a query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_NAMES
from ..functions import stats
from ..sources import panel as source
from ..sources.staging import staged
from . import backtest, gates, prices
from .formula import evaluate, structural_key, with_formulas

#: Endings of symbols that are rights, warrants or partly paid, parts of symbols that are funds, and prefixes of ISINs that are funds or twin lines.
RIGHTS = r"-RE\d?$|-RR$|-RT$|-E\d$|-N\d$|-PP$|-BL$|-W\d?$|PARTLY|WARRANT"
FUND_NAMES = r"BEES$|ETF$|IETF$|LIQUID|GOLD\d*$|SILV|SDL|NIFTY\d|SENSEX\d|MOM\d|MON\d|MAFANG|LOWVOL|MULTICAP|MIDCAP\d*$|SMALLCAP\d*$|MIDSMALL|TOP\d+|MOMENTUM\d|QUALITY\d|VALUE\d|ALPHA\d*$|EQUAL\d|PSUBANK$|PSUBNK|CPSEETF|BANKBETA|NIFTYBETA|GROWW(?:SLVR|LIQID|DEFNC|EV)|HDFC(?:NIFTY|S|M)|AXISNIFTY|ICICISILVE|TATSILV|CONSUMBEES"
FUND_ISINS = ("INF", "IN9")


def first_known(rows: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], default: Column, out: str) -> DataFrame:
    """``out`` from the first source (name, DataFrame of key and value) that has the row's key, else the default; ``source`` names it. Spark broadcasts a source where its size allows."""
    value, name = F.lit(None), F.lit(None)
    for i, (label, table) in enumerate(sources):
        rows = rows.join(table.select(F.col(table.columns[0]).alias(key), F.col(table.columns[1]).alias(f"_v{i}")).dropDuplicates([key]), key, "left")
        value, name = F.coalesce(value, F.col(f"_v{i}")), F.coalesce(name, F.when(F.col(f"_v{i}").isNotNull(), label))
    return rows.withColumns({out: F.coalesce(value, default), "source": F.coalesce(name, F.lit("unknown"))}).drop(*(f"_v{i}" for i in range(len(sources))))


def non_equity(symbol: Column, isin: Column, patterns: Sequence[str] = (RIGHTS, FUND_NAMES)) -> Column:
    """Whether a line is provably no common equity: by its ISIN's prefix or its symbol."""
    fund = reduce(lambda a, b: a | b, (F.coalesce(isin.startswith(p), F.lit(False)) for p in FUND_ISINS))
    return fund | reduce(lambda a, b: a | b, (F.coalesce(symbol.rlike(p), F.lit(False)) for p in patterns))


def by_era(legacy: DataFrame, modern: DataFrame, legacy_last: str, modern_first: str, *order: str) -> DataFrame:
    """One panel of two eras of files: the legacy one, whose vwap is value over volume, up to its last day, and the modern one from its first; of rows of a date and symbol the first by era and the order given stays."""
    a = legacy.where(F.col("date") <= F.lit(legacy_last).cast("date")).withColumns({"vwap": F.try_divide("value", "volume"), "era": F.lit(1)})
    b = modern.where(F.col("date") >= F.lit(modern_first).cast("date")).withColumn("era", F.lit(2))
    return prices.clean(a.drop("value").unionByName(b, allowMissingColumns=True), "era", *order)


def nearest(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """target, date: of the calendar's dates the nearest to each target, the earlier of two; one pass over both, sorted together. A row per date, in one task."""
    both = targets.select(F.col("target").alias("at"), F.lit(None).cast("date").alias("date")).distinct().unionByName(calendar.select(F.col("date").alias("at"), "date").distinct())
    w = Window.orderBy("at")
    near = both.withColumns({"before": F.last("date", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "after": F.first("date", True).over(w.rangeBetween(0, Window.unboundedFollowing))}).where("date IS NULL")
    pick = F.when(F.col("before").isNull() | (F.datediff("after", "at") < F.datediff("at", "before")), F.col("after")).otherwise(F.col("before"))
    return near.select(F.col("at").alias("target"), pick.alias("date"))


def as_supplied(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, symbol: each date has the members of the last snapshot (effective, symbol) up to it, carried forward until the next one."""
    ends = snapshots.select("effective").distinct()
    both = calendar.select("date").distinct().withColumn("own", F.lit(None).cast("date")).unionByName(ends.select(F.col("effective").alias("date"), F.col("effective").alias("own")))
    w = Window.orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    days = both.withColumn("effective", F.last("own", True).over(w)).where("own IS NULL").select("date", "effective")
    return days.join(snapshots.distinct(), "effective").select("date", "symbol")


def reconcile(supplied: DataFrame, real: DataFrame) -> DataFrame:
    """real_n, supplied_n, missing_n, missing_pct: the last real members that no snapshot ever had."""
    last = real.agg(F.max("date").alias("date"))
    today = real.join(last, "date").select("symbol").distinct()
    known = supplied.select("symbol").distinct().withColumn("_known", F.lit(True))
    both = today.join(known, "symbol", "left").agg(F.count("*").alias("real_n"), F.count_if(F.col("_known").isNull()).alias("missing_n"))
    return both.crossJoin(known.agg(F.count("*").alias("supplied_n"))).select("real_n", "supplied_n", "missing_n", F.round(100 * F.try_divide("missing_n", "real_n"), 6).alias("missing_pct"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows and _n, their place from 1 in a full order: dealt by ranges, numbered inside each, and moved on by the counts of the ranges before, so no task sees all rows."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # a row per range
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_n", local).join(before, "_part").withColumn("_n", F.col("_n") + F.col("_before")).drop("_part", "_before")


def batches(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Rows in equal batches by their order; the remainder goes."""
    placed = numbered(rows, order)
    size = rows.agg(F.floor(F.count("*") / n).alias("_size"))
    return placed.crossJoin(size).withColumn("batch", F.floor((F.col("_n") - 1) / F.col("_size")).cast("int")).where(F.col("batch") < n).drop("_n", "_size")


def last_values(rows: DataFrame, key: str, value: str, order: Sequence[str], k: int = 10) -> DataFrame:
    """key, last: the last k values by order, the newest at the end; no group is gathered whole."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    kept = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]).alias("last"))


def noise(seed: str = "noise") -> Column:
    """A uniform number in [-0.5, 0.5) for each date and symbol, from a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("date").cast("string"), "symbol").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) - 0.5


def lucky_year(rows: DataFrame, year: int) -> DataFrame:
    """sig: noise, but in one year the next return itself."""
    return rows.withColumn("sig", F.when(F.year("date") == year, F.coalesce("fwd_ret_1", F.lit(0.0))).otherwise(noise("lucky")))


def thin_edge(rows: DataFrame, edge: float = 0.06) -> DataFrame:
    """sig: a little one-day reversal in much noise that ranks anew each day."""
    rows = with_formulas(rows, {"_rev": "rank(mul(-1, returns))"})
    return rows.withColumn("sig", edge * F.coalesce(F.col("_rev") - 0.5, F.lit(0.0)) + (1 - edge) * noise("thin")).drop("_rev")


def crosscheck(own: DataFrame, other: DataFrame) -> DataFrame:
    """symbol, n, median_diff, close_share: how far closes of two sources are apart where both have a row."""
    d = own.select("date", "symbol", F.col("close").alias("a")).join(other.select("date", "symbol", F.col("close").alias("b")), ["date", "symbol"]).withColumn("diff", F.abs(F.col("b") / F.col("a") - 1))
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("diff", 0.5).alias("median_diff"), F.avg((F.col("diff") <= 0.01).cast("double")).alias("close_share"))


#: Formulas of which some differ in their numbers alone.
KNOBS = {"d5": "delta(close, 5)", "d10": "delta(close, 10)", "v5": "ts_std(returns, 5)", "v10": "ts_std(returns, 10)", "v21": "ts_std(returns, 21)", "vol": "mul(-1, volume)"}


def register() -> None:
    from ..oracles import sql
    from .queries import IC_SUMMARY, LAB, ic_cte, labelled, query, r, summary

    day = "CAST(o_orderdate AS DATE)"
    chain = f"legacy AS (SELECT o_custkey, 'IN' || max_by(o_orderkey, ({day}, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), listed AS (SELECT o_custkey, 'IN' || min(o_orderkey) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), acts AS (SELECT o_custkey, 'IN' || min(o_orderkey) AS v FROM orders WHERE o_totalprice > 200000 GROUP BY 1)"

    @query("isin_chain", f"WITH {chain} SELECT c_name AS symbol, coalesce(l.v, s.v, a.v, 'UNK_' || c_name) AS isin, CASE WHEN l.v IS NOT NULL THEN 'legacy' WHEN s.v IS NOT NULL THEN 'listing' WHEN a.v IS NOT NULL THEN 'actions' ELSE 'unknown' END AS source FROM customer LEFT JOIN legacy l ON l.o_custkey = c_custkey LEFT JOIN listed s ON s.o_custkey = c_custkey LEFT JOIN acts a ON a.o_custkey = c_custkey")
    def isin_chain(spark, sf_dir):
        o = source.read(spark, sf_dir, "orders")
        tag = lambda c: F.concat(F.lit("IN"), c.cast("string"))
        legacy = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(tag(F.max_by("o_orderkey", F.struct(F.to_date("o_orderdate"), "o_orderkey"))).alias("v"))
        listed = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(tag(F.min("o_orderkey")).alias("v"))
        acts = o.where("o_totalprice > 200000").groupBy("o_custkey").agg(tag(F.min("o_orderkey")).alias("v"))
        rows = source.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("symbol"))
        return first_known(rows, "key", [("legacy", legacy), ("listing", listed), ("actions", acts)], F.concat(F.lit("UNK_"), F.col("symbol")), "isin").select("symbol", "isin", "source")

    @query("sector_map", "SELECT s_name AS symbol, coalesce(CASE WHEN n.n_regionkey < 2 THEN n.n_name END, h.sector, 'Unknown') AS sector, CASE WHEN n.n_regionkey < 2 THEN 'isin' WHEN h.sector IS NOT NULL THEN 'hand' ELSE 'unknown' END AS source FROM supplier LEFT JOIN nation n ON n_nationkey = s_nationkey LEFT JOIN (VALUES (8, 'Energy'), (9, 'Metals'), (18, 'Textiles')) h(key, sector) ON h.key = s_nationkey")
    def sector_map(spark, sf_dir):
        rows = source.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("key"), F.col("s_name").alias("symbol"))
        official = source.read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("long"), "n_name")
        hand = spark.createDataFrame([(8, "Energy"), (9, "Metals"), (18, "Textiles")], "key long, sector string")
        return first_known(rows, "key", [("isin", official), ("hand", hand)], F.lit("Unknown"), "sector").select("symbol", "sector", "source")

    @query("non_equity", "SELECT p_partkey, regexp_matches(upper(p_name), 'GOLD\\d*$|SILV') OR p_brand LIKE 'IN9%' AS dropped FROM part")
    def non_equity_(spark, sf_dir):
        return source.read(spark, sf_dir, "part").select("p_partkey", non_equity(F.upper("p_name"), F.col("p_brand"), (RIGHTS, r"GOLD\d*$|SILV")).alias("dropped"))

    eras = "raw AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol, l_extendedprice / l_quantity AS close, l_quantity AS volume, l_extendedprice / l_quantity * (1 + l_discount) AS high, l_extendedprice / l_quantity * (1 - l_discount) AS low, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS era, CASE WHEN l_linestatus = 'F' THEN l_extendedprice / l_quantity ELSE l_extendedprice * (1 - l_tax) / l_quantity END AS vwap, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity > 0), inside AS (SELECT * FROM raw WHERE (era = 1 AND date <= DATE '1998-06-30') OR (era = 2 AND date >= DATE '1998-01-01'))"

    def bars_of(spark, sf_dir, status: str):
        price = F.col("l_extendedprice") / F.col("l_quantity")
        rows = source.read(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == status) & F.col("l_returnflag").isin("A", "N") & (F.col("l_quantity") > 0))
        return rows.select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), price.alias("close"), F.col("l_quantity").alias("volume"), (price * (1 + F.col("l_discount"))).alias("high"), (price * (1 - F.col("l_discount"))).alias("low"), F.col("l_extendedprice").alias("value"), (F.col("l_extendedprice") * (1 - F.col("l_tax")) / F.col("l_quantity")).alias("vwap"), "l_orderkey", "l_linenumber", "l_partkey")

    @query("prices_era_scan", f"WITH {eras} SELECT date, symbol, era, round(close, 9) AS close, volume, round(least(greatest(vwap, low), high), 9) AS vwap FROM (SELECT *, row_number() OVER (PARTITION BY date, symbol ORDER BY era, close, volume, l_orderkey, l_linenumber, l_partkey) AS k FROM inside WHERE close > 0 AND high >= low AND low > 0) WHERE k = 1")
    def prices_era_scan(spark, sf_dir):
        """Rows of kept series from two eras; of a date and symbol's first the earlier era, then the lowest close."""
        out = by_era(bars_of(spark, sf_dir, "F"), bars_of(spark, sf_dir, "O").drop("value"), "1998-06-30", "1998-01-01", "close", "volume", "l_orderkey", "l_linenumber", "l_partkey")
        return out.select("date", "symbol", "era", r("close", 9).alias("close"), "volume", r("vwap", 9).alias("vwap"))

    @query("nearest_date", sql.query([sql.panel(), f"cal AS (SELECT DISTINCT date FROM panel), t AS (SELECT DISTINCT {day} AS target FROM orders)"], "SELECT target, coalesce(CASE WHEN b IS NULL OR date_diff('day', target, a) < date_diff('day', b, target) THEN a END, b) AS date FROM (SELECT target, (SELECT max(date) FROM cal WHERE date <= target) AS b, (SELECT min(date) FROM cal WHERE date >= target) AS a FROM t)"))
    def nearest_date(spark, sf_dir):
        return nearest(source.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("target")), source.panel(spark, sf_dir))

    snaps = "snaps AS (SELECT DISTINCT CAST(DATE '1995-06-01' + CAST(p_size * 45 AS INTEGER) AS DATE) AS effective, p_brand AS symbol FROM part)"
    given = "given AS (SELECT date, symbol FROM (SELECT date, (SELECT max(effective) FROM snaps WHERE effective <= date) AS effective FROM (SELECT DISTINCT date FROM panel)) JOIN snaps USING (effective))"

    def snapshots(spark, sf_dir):
        return source.read(spark, sf_dir, "part").select(F.date_add(F.lit("1995-06-01").cast("date"), (F.col("p_size") * 45).cast("int")).alias("effective"), F.col("p_brand").alias("symbol")).distinct()

    @query("snapshot_members", sql.query([sql.panel(), snaps, given], "SELECT date, symbol FROM given"))
    def snapshot_members(spark, sf_dir):
        return as_supplied(snapshots(spark, sf_dir), source.panel(spark, sf_dir))

    @query("universe_reconcile", sql.query([sql.panel(), snaps, given, "real AS (SELECT date, symbol FROM bars), today AS (SELECT DISTINCT symbol FROM real WHERE date = (SELECT max(date) FROM real)), known AS (SELECT DISTINCT symbol FROM given)"], "SELECT count(*) AS real_n, (SELECT count(*) FROM known) AS supplied_n, count(*) FILTER (symbol NOT IN (SELECT symbol FROM known)) AS missing_n, round(100.0 * count(*) FILTER (symbol NOT IN (SELECT symbol FROM known)) / count(*), 6) AS missing_pct FROM today"))
    def universe_reconcile(spark, sf_dir):
        bars = source.bars(source.trades(spark, sf_dir))
        return reconcile(as_supplied(snapshots(spark, sf_dir), source.panel(spark, sf_dir)), bars.select("date", "symbol"))

    @query("batch_rates", "SELECT batch, count(*) AS n, round(avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0 END), 6) AS first_pass, round(avg(CASE WHEN s_acctbal > 5000 THEN 1.0 ELSE 0 END), 6) AS all_pass FROM (SELECT *, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // (count(*) OVER () // 6) AS INTEGER) AS batch FROM supplier) WHERE batch < 6 GROUP BY 1")
    def batch_rates(spark, sf_dir):
        rate = lambda c: r(F.avg(F.expr(c).cast("double")))
        return batches(source.read(spark, sf_dir, "supplier"), "s_suppkey", 6).groupBy("batch").agg(F.count("*").alias("n"), rate("s_acctbal > 0").alias("first_pass"), rate("s_acctbal > 5000").alias("all_pass"))

    @query("last_values", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10 GROUP BY 1")
    def last_values_(spark, sf_dir):
        return last_values(source.read(spark, sf_dir, "events"), "user_id", "event_id", ("ts", "event_id")).select("user_id", F.array_join(F.transform("last", lambda x: x.cast("string")), ",").alias("last"))

    @query("largest_moves", sql.query([sql.panel()], "SELECT date, symbol, round(returns, 6) AS returns FROM panel WHERE returns IS NOT NULL ORDER BY round(abs(returns), 6) DESC, date, symbol LIMIT 25"))
    def largest_moves(spark, sf_dir):
        return source.panel(spark, sf_dir).where("returns IS NOT NULL").select("date", "symbol", r("returns").alias("returns")).orderBy(F.desc(F.abs("returns")), "date", "symbol").limit(25)

    @query("head_tail", sql.query([sql.panel()], "SELECT symbol, date, round(close, 9) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS a, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM bars) WHERE a <= 3 OR b <= 3"))
    def head_tail(spark, sf_dir):
        w = Window.partitionBy("symbol")
        d = source.bars(source.trades(spark, sf_dir)).withColumns({"a": F.row_number().over(w.orderBy("date")), "b": F.row_number().over(w.orderBy(F.desc("date")))})
        return d.where("a <= 3 OR b <= 3").select("symbol", "date", r("close", 9).alias("close"))

    def parts(spark, sf_dir):
        return source.panel(spark, sf_dir, by="supplier").where("close IS NOT NULL")

    @query("split_symbols", sql.query([sql.panel("week", "supplier")], "SELECT symbol, " + ", ".join(f"bool_or({sql.split(k)}) AS in_{k}" for k in ("train", "val_a", "val_b")) + " FROM panel WHERE close IS NOT NULL GROUP BY symbol HAVING bool_or(" + " OR ".join(sql.split(k) for k in ("train", "val_a", "val_b")) + ")"))
    def split_symbols(spark, sf_dir):
        """Symbols of any of the open splits, and in which they trade."""
        flags = {k: backtest.in_split(k) for k in ("train", "val_a", "val_b")}
        return parts(spark, sf_dir).groupBy("symbol").agg(*(F.bool_or(c).alias(f"in_{k}") for k, c in flags.items())).where("in_train OR in_val_a OR in_val_b")

    @query("symbols_summary", sql.query([sql.panel("week", "supplier")], "SELECT symbol, count(close) AS n, min(date) FILTER (close IS NOT NULL) AS first, max(date) FILTER (close IS NOT NULL) AS last, max_by(round(close, 9), date) FILTER (close IS NOT NULL) AS last_close FROM panel GROUP BY symbol"))
    def symbols_summary(spark, sf_dir):
        d = parts(spark, sf_dir)
        return d.groupBy("symbol").agg(F.count("close").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), r(F.max_by("close", "date"), 9).alias("last_close"))

    @query("window_ic", sql.query([*LAB, ic_cte("sig", "fwd_ret_5_demeaned", "sig", least=MIN_NAMES)], f"SELECT {IC_SUMMARY} FROM ics WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-11-30'"))
    def window_ic(spark, sf_dir):
        ics = stats.daily_ic(labelled(spark, sf_dir), "sig", "fwd_ret_5_demeaned", least=MIN_NAMES)
        return summary(stats.ic_summary(ics.where(F.col("date").between("1998-03-01", "1998-11-30"))))

    def noise_sql(seed: str) -> str:
        return f"(CAST('0x' || substr(md5('{seed}|' || CAST(date AS VARCHAR) || '|' || symbol), 1, 8) AS BIGINT) / 4294967296.0 - 0.5)"

    @query("lucky_year", sql.query([*LAB[:2], f"lucky AS (SELECT date, CASE WHEN year(date) = 1998 THEN coalesce(fwd_ret_1, 0) ELSE {noise_sql('lucky')} END AS sig, fwd_ret_1_demeaned FROM lab)", ic_cte("sig", "fwd_ret_1_demeaned", "lucky", least=MIN_NAMES)], "SELECT year(date) AS year, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ics GROUP BY 1"))
    def lucky_year_(spark, sf_dir):
        rows = lucky_year(source.fwd_labels(source.panel(spark, sf_dir)), 1998)
        ics = stats.daily_ic(rows, "sig", "fwd_ret_1_demeaned", least=MIN_NAMES)
        return ics.groupBy(F.year("date").alias("year")).agg(r(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n"))

    @query("thin_edge", sql.query([*LAB[:2], sql.formula("rank(mul(-1, returns))", "lab", "rev", "e"), f"thin AS (SELECT date, 0.06 * coalesce(rev - 0.5, 0) + 0.94 * {noise_sql('thin')} AS sig, fwd_ret_1_demeaned FROM rev)", ic_cte("sig", "fwd_ret_1_demeaned", "thin", least=MIN_NAMES)], f"SELECT {IC_SUMMARY} FROM ics"))
    def thin_edge_(spark, sf_dir):
        rows = thin_edge(source.fwd_labels(source.panel(spark, sf_dir)))
        return summary(stats.ic_summary(stats.daily_ic(rows, "sig", "fwd_ret_1_demeaned", least=MIN_NAMES)))

    @query("prices_crosscheck", sql.query([sql.panel(), "other AS (SELECT date, symbol, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close FROM trades WHERE l_returnflag = 'N' GROUP BY 1, 2)"], "SELECT symbol, count(*) AS n, round(quantile_cont(abs(o.close / b.close - 1), 0.5), 6) AS median_diff, round(avg(CASE WHEN abs(o.close / b.close - 1) <= 0.01 THEN 1.0 ELSE 0 END), 6) AS close_share FROM bars b JOIN other o USING (date, symbol) GROUP BY symbol"))
    def prices_crosscheck(spark, sf_dir):
        trades = source.trades(spark, sf_dir)
        return summary(crosscheck(source.bars(trades), source.bars(trades.where("delivered > 0"))))

    knob_sql, last = list(LAB[:2]), "lab"
    for k, f in KNOBS.items():
        knob_sql.append(sql.formula(f, last, k, f"k_{k}"))
        last = k
    knob_sql.append("knobs AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, date, round({last}.{k}, 12) AS sig, fwd_ret_5_demeaned FROM {last}" for k in KNOBS) + ")")
    knob_sql += [ic_cte("sig", "fwd_ret_5_demeaned", "knobs", keys="name, date", least=MIN_NAMES), "keys AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{structural_key(f)}')" for k, f in KNOBS.items()) + ") t(name, cluster))"]
    knob_sql.append("inside AS (SELECT x.name AS a, y.name AS b, k.cluster, covar_samp(x.ic, y.ic) / (stddev_samp(x.ic) * stddev_samp(y.ic)) AS c FROM ics x JOIN ics y ON x.date = y.date AND x.name < y.name JOIN keys k ON k.name = x.name JOIN keys l ON l.name = y.name AND l.cluster = k.cluster GROUP BY 1, 2, 3)")

    @query("effective_trials", sql.query(knob_sql, "SELECT round(sum(1 + (m - 1) * (1 - coalesce(c, 0))), 6) AS effective_trials FROM (SELECT cluster, count(*) AS m FROM keys GROUP BY 1) LEFT JOIN (SELECT cluster, avg(abs(c)) AS c FROM inside GROUP BY 1) USING (cluster)"))
    def effective_trials(spark, sf_dir):
        wide = evaluate(source.fwd_labels(source.panel(spark, sf_dir)), KNOBS, ("date", "symbol", "fwd_ret_5_demeaned"))
        long = wide.select("date", "fwd_ret_5_demeaned", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.round(F.col(k), 12).alias("sig")) for k in KNOBS))).alias("x")).select("date", "fwd_ret_5_demeaned", "x.name", "x.sig")
        ics = stats.daily_ic(long, "sig", "fwd_ret_5_demeaned", least=MIN_NAMES, keys=("name", "date"))
        keys = spark.createDataFrame([(k, structural_key(f)) for k, f in KNOBS.items()], "name string, cluster string")
        return summary(gates.effective_trials(keys, gates.pair_corr(ics, "date", "name", "ic", list(KNOBS))))
