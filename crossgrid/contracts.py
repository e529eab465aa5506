"""Schemas of the panel's tables, and their checks in one pass each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import HORIZONS


@dataclass(frozen=True)
class Contract:
    """Columns with types, row rules (SQL that every row obeys), and columns that may be null throughout."""

    columns: dict[str, str]
    rules: dict[str, str] = field(default_factory=dict)
    may_be_null: frozenset[str] = frozenset()
    key: tuple[str, ...] = ("date", "symbol")


_KEY = {"date": "date", "symbol": "string"}
OHLCV = Contract(
    _KEY | {c: "double" for c in ("open", "high", "low", "close", "volume", "close_raw", "volume_raw", "vwap", "n_trades")} | {"isin": "string", "source": "string", "series": "string"},
    {"close_positive": "close > 0", "high_low": "high >= low", "volume": "volume >= 0", "vwap_inside": "vwap BETWEEN low AND high", "series": "series IN ('EQ', 'BE')"},
)
MEMBERSHIP = Contract(_KEY | {"in_universe": "boolean"})
FEATURES = Contract(
    _KEY | {c: "double" for c in ("mom_21", "mom_126", "rev_5", "vol_21", "beta_63", "amihud_21", "turnover_21", "dist_52wh", "max_ret_21", "delivery_pct", "size_proxy")} | {"sector": "string"},
    {"below_high": "dist_52wh <= 1e-9"},
    frozenset({"delivery_pct"}),
)
LABELS = Contract(_KEY | {f"fwd_ret_{h}{d}": "double" for h in HORIZONS for d in ("", "_demeaned")})


def schema_errors(rows: DataFrame, contract: Contract) -> list[str]:
    have = dict(rows.dtypes)
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in contract.columns.items() if have.get(c) != t]


def validate(rows: DataFrame, contract: Contract) -> list[str]:
    """What is wrong: the schema, columns null throughout, broken rules, repeated keys. Rows are read twice: once for all counts, once for keys."""
    errors = schema_errors(rows, contract)
    if errors:
        return errors
    nan = [F.count_if(F.isnan(c)).alias(f"nan_{c}") for c, t in contract.columns.items() if t == "double"]
    one = rows.agg(F.count("*").alias("n"), *(F.count(c).alias(f"has_{c}") for c in contract.columns), *(F.count_if(~F.expr(r)).alias(f"rule_{k}") for k, r in contract.rules.items()), *nan).first()
    if one.n:
        errors += [f"{c}: null in every row" for c in contract.columns if not one[f"has_{c}"] and c not in contract.may_be_null]
    errors += [f"{k}: {one[f'rule_{k}']} rows" for k in contract.rules if one[f"rule_{k}"]]
    errors += [f"{c}: NaN in {one[f'nan_{c}']} rows" for c, t in contract.columns.items() if t == "double" and one[f"nan_{c}"]]
    twice = rows.groupBy(*contract.key).count().where("count > 1").count()
    return [*errors, *([f"{twice} keys occur more than once"] if twice else [])]
