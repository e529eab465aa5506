"""The (date, symbol) panel: from trade-like rows to a dense grid, and labels on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HORIZONS

KEYS = ("date", "symbol")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, bucket: str = "week", by: str = "brand") -> DataFrame:
    """Line items as trades: date bucket, symbol, sector, unit price, and a full order inside a bucket."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    if by == "brand":
        names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), F.substring("p_brand", 1, 7).alias("sector"))
        items = items.join(names, "l_partkey")
    else:
        names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol"), F.col("s_nationkey").cast("string").alias("sector"))
        items = items.join(names, "l_suppkey")
    return items.where("l_quantity > 0").select(
        F.to_date(F.date_trunc(bucket, "l_shipdate")).alias("date"),
        "symbol",
        "sector",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("delivered"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("at"),
    )


def bars(rows: DataFrame) -> DataFrame:
    """One row per date and symbol: open, high, low, close, volume, vwap, n_trades, value, delivery_pct, sector. One shuffle with map-side combining.

    The first and last trade need a sort; by a hash before the keys it compares numbers, as names begin alike."""
    out = rows.groupBy(F.xxhash64("date", "symbol").alias("_hash"), "date", "symbol").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        (F.sum("value").cast("double") / F.sum("l_quantity")).alias("vwap"),
        F.count("*").cast("double").alias("n_trades"),
        (F.sum("delivered") / F.sum("l_quantity")).alias("delivery_pct"),
        F.min("sector").alias("sector"),
    )
    return out.drop("_hash")


def densify(rows: DataFrame) -> DataFrame:
    """A row for every date of the calendar and every symbol, with ``pos``, the number of the date. The calendar has a row per date and is numbered in one task."""
    calendar = rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    symbols = rows.groupBy("symbol").agg(F.min("sector").alias("sector"))
    return calendar.crossJoin(symbols).join(rows.drop("sector"), list(KEYS), "left")


def over_symbol() -> "Window":
    return Window.partitionBy("symbol").orderBy("pos")


def trailing(d: int) -> "Window":
    return over_symbol().rowsBetween(-(d - 1), 0)


def own_median(x: Column, d: int) -> Column:
    """Median of the last d own rows; null before there are d of them."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(d - 1), 0)
    if d > 8:
        return F.when(F.count(x).over(w) == d, F.percentile(x, 0.5).over(w))
    own = Window.partitionBy("symbol").orderBy("date")  # few: sorted side by side, where a moving percentile begins again at each row
    last = F.sort_array(F.array(*(F.lag(x, k).over(own) for k in range(d))))
    return F.when(F.count(x).over(w) == d, 0.5 * last[(d - 1) // 2] + 0.5 * last[d // 2])


def with_size(rows: DataFrame, d: int = 63) -> DataFrame:
    """size_proxy: log of the median turnover of d own rows."""
    return rows.withColumn("size_proxy", F.ln(own_median(F.col("close") * F.col("volume"), d)))


def panel(spark: SparkSession, sf_dir: str, bucket: str = "week", by: str = "brand") -> DataFrame:
    """The dense panel with all legal fields."""
    return panel_of(bars(trades(spark, sf_dir, bucket, by)))


def panel_of(rows: DataFrame) -> DataFrame:
    """The same from bars; a query that needs them more than once writes them first."""
    dense = densify(with_size(rows))
    before = F.lag("close").over(over_symbol())
    return dense.withColumns({"returns": F.try_divide(F.col("close"), before) - 1, "close_raw": F.col("close"), "volume_raw": F.col("volume")})


def fwd_labels(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, member: Column | None = None) -> DataFrame:
    """fwd_ret_h from the open after the signal's date to that h later, the same without the mean of members on the date, and label_end_h: the date at which it is known, the last one where that is past it."""
    w, day = over_symbol(), Window.partitionBy("date")
    last = F.max("date").over(Window.partitionBy("symbol"))
    rows = rows.withColumns({f"label_end_{h}": F.coalesce(F.lead("date", 1 + h).over(w), last) for h in horizons})
    member = F.lit(True) if member is None else member
    rows = rows.withColumns({f"fwd_ret_{h}": F.try_divide(F.lead("open", 1 + h).over(w), F.lead("open", 1).over(w)) - 1 for h in horizons})
    return rows.withColumns({f"fwd_ret_{h}_demeaned": F.col(f"fwd_ret_{h}") - F.avg(F.when(member, F.col(f"fwd_ret_{h}"))).over(day) for h in horizons})
