"""Corporate actions: parsing their texts, anchoring them to prices, adjusting, and checking prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of action texts.
BONUS = r"(?i)bonus\b[\s:.\-]{0,4}(\d+)\s*:\s*(\d+)"
SPLIT = r"(?i)face\s*val|\bf\s*\.?\s*v\s*\.?\b|\bsplt\b|\bsplit\b|sub-?division"
SPLIT_RATIO = r"(?i)(?:rs|re)\.?\s*([\d.]+)\s*/?\s*-?\s*(?:per\s+share\s+)?[^0-9]*?\bto\b\s*(?:rs|re)\.?\s*([\d.]+)"
DEMERGER = r"(?i)demerg|amalgamat|scheme of arr?angement|\bmerger\b|composite scheme"


def action(subject: Column) -> Column:
    """struct(type, ratio) of an action's text; the ratio, by which earlier prices are multiplied, is null but for bonuses and splits."""
    s = F.coalesce(subject, F.lit(""))
    number = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("double")
    a, b = number(BONUS, 1), number(BONUS, 2)
    bonus = s.rlike(BONUS)
    bonus_ratio = F.when(bonus & (a + b > 0), b / (a + b))
    old, new = number(SPLIT_RATIO, 1), number(SPLIT_RATIO, 2)
    keyword = s.rlike(SPLIT)
    split_ratio = F.when(keyword & (old > 0) & (new > 0) & (new < old), new / old)
    hit = bonus_ratio.isNotNull() | split_ratio.isNotNull()
    kind = F.when(s.rlike(DEMERGER), "demerger").when(hit & bonus & keyword, "bonus+split").when(hit & bonus, "bonus").when(hit, "split").when(s.rlike("(?i)dividend"), "dividend").otherwise("other")
    ratio = F.when(~s.rlike(DEMERGER) & hit, F.coalesce(bonus_ratio, F.lit(1.0)) * F.coalesce(split_ratio, F.lit(1.0)))
    return F.struct(kind.alias("type"), ratio.alias("ratio"))


def anchors(rows: DataFrame, events: DataFrame, reach: int = 3, tolerance: float = 0.2) -> DataFrame:
    """Of each event (symbol, ex_date, ratio): the first of the own rows within ``reach`` of it whose price break is near the ratio, else its ex date. Events of a day are one, of their product.
    Each event finds its row by an as-of window over rows and events together, and meets the rows around it by their numbers."""
    own = Window.partitionBy("symbol").orderBy("date")
    d = rows.where("close IS NOT NULL").select("symbol", "date", F.row_number().over(own).alias("rn"), F.try_divide(F.col("close"), F.lag("close").over(own)).alias("jump"))
    e = events.where("ratio > 0 AND ratio < 1").groupBy("symbol", "ex_date").agg(F.product("ratio").alias("ratio"))
    both = d.select("symbol", "date", "rn", F.lit(None).cast("double").alias("ratio")).unionByName(e.select("symbol", F.col("ex_date").alias("date"), F.lit(None).cast("int").alias("rn"), "ratio"))
    later = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("rn").asc_nulls_last())  # rows of a day come before its events
    at = both.withColumn("at", F.min("rn").over(later.rowsBetween(Window.unboundedPreceding, 0))).where("rn IS NULL AND at IS NOT NULL")
    around = at.select("symbol", F.col("date").alias("ex_date"), "ratio", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("rn"))
    near = around.join(d, ["symbol", "rn"]).where(F.abs(F.col("jump") / F.col("ratio") - 1) <= tolerance).groupBy("symbol", "ex_date").agg(F.min("date").alias("anchor"))
    return e.join(near, ["symbol", "ex_date"], "left").select("symbol", "ex_date", "ratio", F.coalesce("anchor", "ex_date").alias("anchor"))


def adjust(rows: DataFrame, anchored: DataFrame) -> DataFrame:
    """factor per row: the product of the ratios of events anchored after it, a running one from the end; close_adj and volume_adj."""
    daily = anchored.groupBy("symbol", F.col("anchor").alias("date")).agg(F.product("ratio").alias("_ratio"))
    both = rows.withColumn("_row", F.lit(True)).join(daily, ["symbol", "date"], "full")
    after = Window.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("factor", F.coalesce(F.product("_ratio").over(after), F.lit(1.0))).where("_row").drop("_row", "_ratio")
    return out.withColumns({"close_adj": F.col("close") * F.col("factor"), "volume_adj": F.col("volume") / F.col("factor")})


def extreme_returns(rows: DataFrame, events: DataFrame, limit: float, days: int = 3) -> DataFrame:
    """Own-row returns beyond the limit, and whether an event is within ``days`` calendar days; each event is joined by the few dates around it."""
    own = Window.partitionBy("symbol").orderBy("date")
    big = rows.where("close IS NOT NULL").select("symbol", "date", (F.try_divide(F.col("close"), F.lag("close").over(own)) - 1).alias("ret")).where(F.abs("ret") > limit)
    near = events.select("symbol", F.explode(F.sequence(F.date_sub("ex_date", days), F.date_add("ex_date", days))).alias("date")).distinct().withColumn("_near", F.lit(True))
    return big.join(near, ["symbol", "date"], "left").select("symbol", "date", "ret", F.coalesce("_near", F.lit(False)).alias("explained"))


def quality(rows: DataFrame) -> DataFrame:
    """check, violations: five checks in one pass."""
    checks = {"close_not_positive": F.col("close") <= 0, "high_below_low": F.col("high") < F.col("low"), "negative_volume": F.col("volume") < 0, "vwap_out_of_range": (F.col("vwap") < F.col("low") - 1e-9) | (F.col("vwap") > F.col("high") + 1e-9), "null_close": F.col("close").isNull()}
    one = rows.agg(*(F.count_if(v).alias(k) for k, v in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks))).alias("x")).select("x.check", "x.violations")


def clean(rows: DataFrame, *order: str) -> DataFrame:
    """Drops impossible bars; volume and n_trades at least 0, vwap from close where unknown or not positive and inside [low, high]; of equal keys the first in the order given."""
    ok = rows.where("date IS NOT NULL AND symbol IS NOT NULL AND NOT coalesce(close <= 0 OR high < low OR low <= 0, false)")
    vwap = F.coalesce(F.when(F.col("vwap") > 0, F.col("vwap")), F.col("close"))
    new = {c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in ("volume", "n_trades") if c in rows.columns}
    ok = ok.withColumns(new | {"vwap": F.least(F.greatest(vwap, "low"), "high")})
    return ok.withColumn("_i", F.row_number().over(Window.partitionBy("date", "symbol").orderBy(*(order or ("close", "volume"))))).where("_i = 1").drop("_i")
