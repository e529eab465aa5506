"""Daily price files of two eras: zipped ones with one layout, plain CSV with another. Of both only files of asked days are opened."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives
from .files import numeric, of_series, read_modern_csv
from .statelog import Files

#: The files' names of columns, by ours.
LEGACY = {"day": "TIMESTAMP", "symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prevclose": "PREVCLOSE", "volume": "TOTTRDQTY", "value": "TOTTRDVAL", "n_trades": "TOTALTRADES", "isin": "ISIN"}
MODERN = {"day": "DATE1", "symbol": "SYMBOL", "series": "SERIES", "open": "OPEN_PRICE", "high": "HIGH_PRICE", "low": "LOW_PRICE", "close": "CLOSE_PRICE", "prevclose": "PREV_CLOSE", "volume": "TTL_TRD_QNTY", "vwap": "AVG_PRICE", "n_trades": "NO_OF_TRADES", "deliv_qty": "DELIV_QTY", "delivery_pct": "DELIV_PER"}
TEXTS = ("day", "symbol", "series", "isin")
DAY = "d-MMM-yyyy"


def _named(rows: DataFrame, names: dict[str, str], series: tuple[str, ...]) -> DataFrame:
    """Our columns, by the files' headers: numbers where they are, days parsed, kept series alone; rows without a day or a symbol go. A column that a file lacks is null."""
    have = {c.strip().upper(): c for c in rows.columns}
    found = rows.select(*((F.trim(F.col(f"`{have[theirs]}`").cast("string")) if theirs in have else F.lit(None).cast("string")).alias(ours) for ours, theirs in names.items()))
    found = numeric(found, *(c for c in names if c not in TEXTS)).withColumn("date", F.try_to_timestamp(F.initcap("day"), F.lit(DAY)).cast("date"))
    return of_series(found, *series).where("date IS NOT NULL AND symbol <> ''").drop("day")


def read_legacy(spark: SparkSession, path: str, first: date | None = None, last: date | None = None, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """Zipped files, by their headers; unreadable archives give nothing. vwap is value over volume."""
    archives.register(spark)
    columns = ", ".join(f"`{c}` string" for c in LEGACY.values())
    rows = spark.read.format("zipped_csv").schema(f"member_date date, {columns}").options(column_date="member_date", first_only="true").load(path=path)
    if first:
        rows = rows.where(F.col("member_date") >= F.lit(first))
    if last:
        rows = rows.where(F.col("member_date") <= F.lit(last))
    out = _named(rows, LEGACY, series)
    return out.withColumns({"vwap": F.try_divide("value", "volume"), "isin": F.when(F.col("isin") != "-", F.col("isin"))}).drop("value")


def read_modern(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None, series: tuple[str, ...] = ("EQ",)) -> DataFrame | None:
    """CSV files of a folder whose names tell a day of the range; None where there are none."""
    days = {n: archives.date_of(n) for n in Files(spark, folder).sizes(folder) if n.lower().endswith(".csv")}
    asked = [f"{folder.rstrip('/')}/{n}" for n, d in sorted(days.items()) if d and (not first or d >= first) and (not last or d <= last)]
    return _named(read_modern_csv(spark, asked), MODERN, series) if asked else None


def read_eras(spark: SparkSession, legacy: str, modern: str, legacy_last: date, modern_first: date, first: date | None = None, last: date | None = None, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """Rows of both eras with a source of 1 or 2: legacy files up to their last day, modern ones from their first; where they overlap, both, for ``prices.clean`` to choose the first."""
    old = read_legacy(spark, legacy, first, min(x for x in (legacy_last, last) if x), series).withColumn("era", F.lit(1))
    new = read_modern(spark, modern, max(x for x in (modern_first, first) if x), last, series)
    return old if new is None else old.unionByName(new.withColumn("era", F.lit(2)), allowMissingColumns=True)
