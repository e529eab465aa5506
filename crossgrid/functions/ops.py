"""The 35 operators of the formula language as Column expressions on the dense panel.

Null means missing and NaN never occurs. Windows over time are the last d rows of the symbol's grid and
need d values; windows over the cross-section are a date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..sources.panel import over_symbol, trailing

def day() -> "Window":
    return Window.partitionBy("date")


def _days(d) -> int:
    n = int(d)
    if n < 1:
        raise ValueError(f"a window must have a day at least, not {d}")
    return n


def _full(x: Column, d: int, value: Column) -> Column:
    return F.when(F.count(x).over(trailing(d)) == d, value)


def _number(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# cross-section


def average_rank(x: Column, *keys: str) -> Column:
    """Rank from 1 among non-null values of the keys, ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    peers = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # in the same sort as the rank
    return F.when(x.isNotNull(), F.rank().over(w) + (peers - 1) / 2)


def rank(x: Column) -> Column:
    """Share of the day's rank; values that agree to twelve decimals tie, so that the last digits of sums decide nothing."""
    x = F.round(x, 12)
    return average_rank(x, "date") / F.count(x).over(day())


def scale(x: Column, a=1.0) -> Column:
    return F.try_divide(x, F.sum(F.abs(x)).over(day())) * a


def demean_cs(x: Column) -> Column:
    return x - F.avg(x).over(day())


def zscore_cs(x: Column) -> Column:
    return F.try_divide(x - F.avg(x).over(day()), F.stddev_pop(x).over(day()))


def sector_neutral(x: Column, sector: Column) -> Column:
    return F.when(sector.isNotNull(), x - F.avg(x).over(Window.partitionBy("date", sector)))


# time


def delay(x: Column, d) -> Column:
    return F.lag(x, _days(d)).over(over_symbol())


def delta(x: Column, d) -> Column:
    return x - delay(x, d)


def _windowed(f: Callable[[Column], Column]) -> Callable[[Column, float], Column]:
    def op(x: Column, d) -> Column:
        d = _days(d)
        return _full(x, d, f(x).over(trailing(d)))

    return op


ts_mean, ts_std, ts_min, ts_max, ts_sum, ts_product = map(_windowed, (F.avg, F.stddev_samp, F.min, F.max, F.sum, F.product))


def ts_rank(x: Column, d) -> Column:
    """Share of the window's values up to today's."""
    d = _days(d)
    held = F.collect_list(x).over(trailing(d))
    return _full(x, d, F.size(F.filter(held, lambda v: v <= F.element_at(held, -1))) / d)


def ts_argmax(x: Column, d) -> Column:
    """Days since the maximum, the earliest of equal ones."""
    d = _days(d)
    held = F.collect_list(x).over(trailing(d))
    return _full(x, d, (F.lit(d) - F.array_position(held, F.array_max(held))).cast("double"))


def decay_linear(x: Column, d) -> Column:
    """Mean with weights 1 to d, the newest heaviest: from the sums of x and of x times position."""
    d = _days(d)
    w = trailing(d)
    pos = F.col("pos").cast("double")
    return _full(x, d, (F.sum(x * pos).over(w) - (pos - d) * F.sum(x).over(w)) / (d * (d + 1) / 2))


def _joint(x: Column, y: Column, d) -> tuple[Column, Column, int]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y), _days(d)


def covariance(x: Column, y: Column, d) -> Column:
    x, y, d = _joint(x, y, d)
    return _full(x, d, F.covar_samp(x, y).over(trailing(d)))


def correlation(x: Column, y: Column, d) -> Column:
    x, y, d = _joint(x, y, d)
    w = trailing(d)
    return _full(x, d, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


# elements


def power(a: Column, b: Column) -> Column:
    return _number(F.pow(a, b))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def signed_power(x: Column, a: Column) -> Column:
    return F.signum(x) * _number(F.pow(F.abs(x), a))


def _pair(f: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def _compare(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(a, b).cast("double")


def if_else(c: Column, a: Column, b: Column) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c > 0, a).otherwise(b)


#: Name to (function, kinds of arguments: x a column, d a number of days or other literal, ? may be left out).
OPERATORS: dict[str, tuple[Callable[..., Column], str]] = {
    "rank": (rank, "x"),
    "scale": (scale, "xd?"),
    "demean_cs": (demean_cs, "x"),
    "zscore_cs": (zscore_cs, "x"),
    "sector_neutral": (sector_neutral, "xx"),
    "delay": (delay, "xd"),
    "delta": (delta, "xd"),
    "ts_mean": (ts_mean, "xd"),
    "ts_std": (ts_std, "xd"),
    "ts_min": (ts_min, "xd"),
    "ts_max": (ts_max, "xd"),
    "ts_sum": (ts_sum, "xd"),
    "ts_rank": (ts_rank, "xd"),
    "ts_argmax": (ts_argmax, "xd"),
    "ts_product": (ts_product, "xd"),
    "decay_linear": (decay_linear, "xd"),
    "correlation": (correlation, "xxd"),
    "covariance": (covariance, "xxd"),
    "add": (lambda a, b: a + b, "xx"),
    "sub": (lambda a, b: a - b, "xx"),
    "mul": (lambda a, b: a * b, "xx"),
    "div": (F.try_divide, "xx"),
    "pow": (power, "xx"),
    "log": (log, "x"),
    "abs": (F.abs, "x"),
    "sign": (F.signum, "x"),
    "signed_power": (signed_power, "xx"),
    "min": (_pair(F.least), "xx"),
    "max": (_pair(F.greatest), "xx"),
    "lt": (_compare(lambda a, b: a < b), "xx"),
    "gt": (_compare(lambda a, b: a > b), "xx"),
    "le": (_compare(lambda a, b: a <= b), "xx"),
    "ge": (_compare(lambda a, b: a >= b), "xx"),
    "eq": (_compare(lambda a, b: a == b), "xx"),
    "if_else": (if_else, "xxx"),
}
#: Windowed operators by what their rows share: the date or the symbol.
SHARED = dict.fromkeys(("rank", "scale", "demean_cs", "zscore_cs", "sector_neutral"), "date") | dict.fromkeys(("delay", "delta", "ts_mean", "ts_std", "ts_min", "ts_max", "ts_sum", "ts_rank", "ts_argmax", "ts_product", "decay_linear", "correlation", "covariance"), "symbol")
#: Operators whose number isn't one of days.
NOT_DAYS = frozenset(("scale",))
FIELDS = ("open", "high", "low", "close", "volume", "vwap", "returns", "n_trades", "delivery_pct", "size_proxy", "sector", "close_raw", "volume_raw")
COMMUTATIVE = frozenset(("add", "mul", "min", "max", "eq"))
SYMMETRIC_HEAD = frozenset(("correlation", "covariance"))
FOLDABLE = frozenset(("add", "sub", "mul", "div", "pow"))
