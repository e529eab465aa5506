"""Exact quantiles of any number of values by digit counts.

A double becomes a long in the same order. Its 64 bits are four digits of 16: a pass counts the next digit of the values that still
share their leading digits with a wanted rank, and the running counts say which digit that rank has. After four passes
the rank's value is known to the last bit. All ranks and keys go through the same passes, each an aggregate with at most 65,536 counts per key and
leading digits, combined before the shuffle; no state holds a key's values, as ``percentile``'s does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

BITS, PASSES = 16, 4
_MANTISSA = 1 << 52


def to_ordered(x: Column) -> Column:
    """A long that orders as the double does: the bits of its size, under its sign. Null for NaN; both zeros are 0."""
    a = F.abs(x.cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("int")
    # a logarithm may be off at powers of two, so the mantissa decides
    part = (a / two(F.floor(guess / 2))) / two(guess - F.floor(guess / 2))
    e = F.when(part >= 2, guess + 1).when((part < 1) & (guess > -1022), guess - 1).otherwise(guess)
    m = F.when(part >= 2, part / 2).when((part < 1) & (guess > -1022), part * 2).otherwise(part)
    normal = (e + 1023).cast("long") * F.lit(_MANTISSA) + ((m - 1) * float(_MANTISSA)).cast("long")
    small = (a * float(2.0**537) * float(2.0**537)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 * _MANTISSA)).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(F.isnan(x.cast("double")), None).when(x < 0, -bits).otherwise(bits)


def from_ordered(k: Column) -> Column:
    """The double of such a long."""
    b = F.abs(k)
    e = F.shiftright(b, 52).cast("int") - 1023
    m = (b % F.lit(_MANTISSA)).cast("double") / float(_MANTISSA)
    half = F.floor(e / 2)
    normal = (m + 1) * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (e - half).cast("double"))
    small = b.cast("double") * float(2.0**-537) * float(2.0**-537)
    size = F.when(e == -1023, small).when(e == 1024, F.lit(float("inf"))).otherwise(normal)
    return F.when(k < 0, -size).otherwise(size)


def order_statistics(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, value): the values at places from 0 of each key's values in order. rows: (keys, x: ordered longs, not null); ranks: (keys, rank), distinct, inside the counts."""
    same = lambda a, b, names: reduce(lambda p, c: p & a[c].eqNullSafe(b[c]), names, F.lit(True))
    now = ranks.select(*keys, "rank", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("below"))
    for k in range(PASSES):
        left = 64 - BITS * k
        rows_ = rows.withColumns({"lead": F.shiftright("x", left) if k else F.lit(0).cast("long"), "digit": F.shiftright("x", left - BITS)})
        wanted = now.select(*keys, "lead").distinct()
        if k:
            rows_ = rows_.join(wanted, same(rows_, wanted, [*keys, "lead"]), "left_semi")
        counts = rows_.groupBy(*keys, "lead", "digit").agg(F.count("*").alias("n"))
        w = Window.partitionBy(*keys, "lead").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(w))
        found = now.join(counts, same(now, counts, [*keys, "lead"]) & (now["rank"] >= now["below"] + counts["upto"] - counts["n"]) & (now["rank"] < now["below"] + counts["upto"]))
        now = staged(found.select(*(now[c] for c in keys), now["rank"], counts["digit"].alias("lead"), (now["below"] + counts["upto"] - counts["n"]).alias("below")))
    return now.select(*keys, "rank", F.col("lead").alias("value"))


def quantiles(rows: DataFrame, value: Column, qs: tuple[float, ...], *keys: str, written: bool = False) -> DataFrame:
    """keys, q (its place in qs) and value: exact quantiles with linear interpolation, as of a sorted list; null and NaN are left out, and so are keys without values. written: the rows are a table already, and can be read once per pass."""
    names = [*keys] or ["_all"]
    given = rows.select(*([F.col(k) for k in keys] or [F.lit(1).alias("_all")]), to_ordered(value).alias("x")).where("x IS NOT NULL")
    given = given if written else staged(given)
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.lit(float(q)).alias("p")) for i, q in enumerate(qs))))
    wanted = given.groupBy(*names).agg(F.count("*").alias("n")).select(*names, "n", asked.alias("w")).select(*names, F.col("w.q").alias("q"), (F.col("w.p") * (F.col("n") - 1)).alias("at"))
    wanted = staged(wanted.withColumns({"low": F.floor("at"), "high": F.ceil("at")}))
    ranks = wanted.select(*names, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = order_statistics(given, ranks, names).withColumn("value", from_ordered(F.col("value")))
    for side in ("low", "high"):
        other = found.select(*(F.col(c).alias(f"_{c}") for c in names), F.col("rank").alias("_rank"), F.col("value").alias(f"v_{side}"))
        on = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"_{c}")), names, F.col(side) == F.col("_rank"))
        wanted = wanted.join(other, on).drop("_rank", *(f"_{c}" for c in names))
    part = F.col("at") - F.col("low")
    return wanted.select(*keys, "q", F.when(part == 0, F.col("v_low")).otherwise(F.col("v_low") + (F.col("v_high") - F.col("v_low")) * part).alias("value"))
