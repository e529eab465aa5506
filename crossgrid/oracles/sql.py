"""DuckDB SQL for the same results, written on its own: a chain of CTEs, one for each operator of a formula."""

from __future__ import annotations

from ..config import HORIZONS, SPLITS
from ..plans.formula import Node, parse

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def panel(bucket: str = "week", by: str = "brand") -> str:
    """CTEs up to ``panel``."""
    if by == "brand":
        name, sector, join = "p_brand", "substr(p_brand, 1, 7)", "part ON p_partkey = l_partkey"
    else:
        name, sector, join = "s_name", "CAST(s_nationkey AS VARCHAR)", "supplier ON s_suppkey = l_suppkey"
    return f"""
trades AS (SELECT CAST(date_trunc('{bucket}', l_shipdate) AS DATE) AS date, {name} AS symbol, {sector} AS sector, l_extendedprice / l_quantity AS price, lineitem.*
  FROM lineitem JOIN {join} WHERE l_quantity > 0),
bars AS (SELECT date, symbol, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS vwap, CAST(count(*) AS DOUBLE) AS n_trades,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS delivery_pct, min(sector) AS sector FROM trades GROUP BY ALL HAVING true),
sized AS (SELECT *, CASE WHEN count(close) OVER w = 63 THEN ln(quantile_cont(close * volume, 0.5) OVER w) END AS size_proxy FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)),
grid AS (SELECT c.date, c.pos, s.symbol, s.sector FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM sized)) c
  CROSS JOIN (SELECT symbol, min(sector) AS sector FROM sized GROUP BY symbol) s),
panel AS (SELECT g.date, g.symbol, g.pos, b.open, b.high, b.low, b.close, b.volume, b.vwap, b.n_trades, b.delivery_pct, g.sector, b.size_proxy,
  b.close / lag(b.close) OVER (PARTITION BY g.symbol ORDER BY g.pos) - 1 AS returns, b.close AS close_raw, b.volume AS volume_raw
  FROM grid g LEFT JOIN sized b ON b.date = g.date AND b.symbol = g.symbol)""".replace("GROUP BY ALL HAVING true", "GROUP BY date, symbol")


def labels() -> str:
    """CTEs ``lab0`` and ``lab`` on ``panel``."""
    fwd = ", ".join(f"lead(open, {1 + h}) OVER w / lead(open, 1) OVER w - 1 AS fwd_ret_{h}" for h in HORIZONS)
    less = ", ".join(f"fwd_ret_{h} - avg(fwd_ret_{h}) OVER (PARTITION BY date) AS fwd_ret_{h}_demeaned" for h in HORIZONS)
    return f"""
lab0 AS (SELECT *, {fwd} FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
lab AS (SELECT *, {less} FROM lab0)"""


def _w(d: int) -> str:
    return f"(PARTITION BY symbol ORDER BY pos ROWS {d - 1} PRECEDING)"


def _full(x: str, d: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_w(d)} = {d} THEN {value} END"


_T = "(PARTITION BY symbol ORDER BY pos)"
_D = "(PARTITION BY date)"


def average_rank(x: str, keys: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 END"


def _pearson(x: str, y: str, d: int, kind: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"
    value = f"covar_samp({a}, {b}) OVER {_w(d)}"
    if kind == "correlation":
        value += f" / nullif(stddev_samp({a}) OVER {_w(d)} * stddev_samp({b}) OVER {_w(d)}, 0)"
    return f"CASE WHEN count({a}) OVER {_w(d)} = {d} THEN {value} END"


def _held(x: str, d: int) -> str:
    return f"(array_agg({x}) OVER {_w(d)})"


def expression(name: str, a: list[str], days: list[float]) -> str:
    """One operator on columns or literals."""
    x, y = a[0], a[1] if len(a) > 1 else ""
    d = int(days[-1]) if days else 0
    simple = {"ts_mean": "avg", "ts_std": "stddev_samp", "ts_min": "min", "ts_max": "max", "ts_sum": "sum", "ts_product": "product"}
    if name in simple:
        return _full(x, d, f"{simple[name]}({x}) OVER {_w(d)}")
    pairs = {"add": "+", "sub": "-", "mul": "*"}
    if name in pairs:
        return f"{x} {pairs[name]} {y}"
    compare = {"lt": "<", "gt": ">", "le": "<=", "ge": ">=", "eq": "="}
    if name in compare:
        return f"CAST({x} {compare[name]} {y} AS DOUBLE)"
    if name in ("correlation", "covariance"):
        return _pearson(x, y, d, name)
    return {
        "rank": lambda: f"({average_rank(f'round({x}, 12)')}) / count({x}) OVER {_D}",
        "scale": lambda: f"{x} / nullif(sum(abs({x})) OVER {_D}, 0) * {days[0] if days else 1}",
        "demean_cs": lambda: f"{x} - avg({x}) OVER {_D}",
        "zscore_cs": lambda: f"({x} - avg({x}) OVER {_D}) / nullif(stddev_pop({x}) OVER {_D}, 0)",
        "sector_neutral": lambda: f"CASE WHEN {y} IS NOT NULL THEN {x} - avg({x}) OVER (PARTITION BY date, {y}) END",
        "delay": lambda: f"lag({x}, {d}) OVER {_T}",
        "delta": lambda: f"{x} - lag({x}, {d}) OVER {_T}",
        "ts_rank": lambda: _full(x, d, f"len(list_filter({_held(x, d)}, lambda v: v <= {x})) / CAST({d} AS DOUBLE)"),
        "ts_argmax": lambda: _full(x, d, f"CAST({d} - list_position({_held(x, d)}, list_max({_held(x, d)})) AS DOUBLE)"),
        "decay_linear": lambda: _full(x, d, "(" + " + ".join(f"{d - k} * (lag({x}, {k}) OVER {_T})" for k in range(d)) + f") / {d * (d + 1) / 2}"),
        "div": lambda: f"{x} / nullif({y}, 0)",
        "pow": lambda: f"CASE WHEN NOT ({x} < 0 AND {y} <> floor({y})) THEN pow({x}, {y}) END",
        "log": lambda: f"CASE WHEN {x} > 0 THEN ln({x}) END",
        "abs": lambda: f"abs({x})",
        "sign": lambda: f"CAST(sign({x}) AS DOUBLE)",
        "signed_power": lambda: f"sign({x}) * pow(abs({x}), {y})",
        "min": lambda: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN least({x}, {y}) END",
        "max": lambda: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN greatest({x}, {y}) END",
        "if_else": lambda: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN {y} ELSE {a[2]} END",
    }[name]()


def formula(text: str, source: str = "panel", out: str = "sig", prefix: str = "f") -> str:
    """CTEs up to one named ``out`` that has the formula's value as a column of that name beside those of ``source``."""
    ctes, last, known = [], source, {}
    windows = ("rank", "scale", "demean_cs", "zscore_cs", "sector_neutral", "delay", "delta", "ts_", "decay_linear", "correlation", "covariance")

    def build(n: Node) -> str:
        nonlocal last
        if n.kind == "const":
            return f"CAST({n.value!r} AS DOUBLE)"
        if n.kind == "field":
            return str(n.value)
        if n not in known:
            is_window = str(n.value).startswith(windows)
            days = [float(a.value) for a in n.args if a.kind == "const"] if is_window else []
            args = [build(a) for a in n.args if not (is_window and a.kind == "const")]
            col = f"{prefix}_{len(ctes)}"
            ctes.append(f"{prefix}_c{len(ctes)} AS (SELECT *, {expression(str(n.value), args, days)} AS {col} FROM {last})")
            last = ctes[-1].split(" ", 1)[0]
            known[n] = col
        return known[n]

    value = build(parse(text))
    return ",\n".join([*ctes, f"{out} AS (SELECT *, CAST({value} AS DOUBLE) AS {out} FROM {last})"])


def split(name: str, col: str = "date") -> str:
    return "(" + " OR ".join(f"{col} BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in SPLITS.parts(name)) + ")"


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select
