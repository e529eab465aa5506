"""Order of events: rules over an ordered log, checked by one scan per key, that name the events which broke them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """At each ``event``: one of ``needs`` has to have come, and none of ``forbids``, since the last of ``since`` (or the beginning). An event itself counts for later ones alone."""

    name: str
    event: str
    needs: tuple[str, ...] = ()
    forbids: tuple[str, ...] = ()
    since: tuple[str, ...] = ()


#: Of a research run: a thesis is written down before anything is tested, a peek follows the statistics of the same generation, once, and nothing is tested after a verdict.
RESEARCH = (
    Rule("tested before registered", "backtest", needs=("preregister",)),
    Rule("peek before statistics", "peek", needs=("statistics",), since=("generation",)),
    Rule("second peek", "peek", forbids=("peek",), since=("generation",)),
    Rule("tested after verdict", "backtest", forbids=("verdict",), since=("generation",)),
)


def violations(events: DataFrame, rules: tuple[Rule, ...], key: str, order: tuple[str, ...], event: str = "event", first: bool = True) -> DataFrame:
    """key, the order's columns, event and rule: the first event of each key that breaks a rule (of one event's rules the first), or all of them.

    The state of a key is, for each event that a rule names, the place at which it came last: running maxima over one order, so a scan holds a few numbers however long the log. Rows that tie in the order are taken in one that isn't defined: give a full one."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    named = sorted({x for rule in rules for x in (*rule.needs, *rule.forbids, *rule.since)})
    rows = events.withColumn("_at", F.row_number().over(w))
    rows = rows.withColumns({f"_last_{k}": F.coalesce(F.max(F.when(F.col(event) == name, F.col("_at"))).over(before), F.lit(0)) for k, name in enumerate(named)})
    last = lambda names: F.greatest(F.lit(0), F.lit(0), *(F.col(f"_last_{named.index(x)}") for x in names))

    def broken(rule: Rule) -> Column:
        since = last(rule.since)
        lacks = last(rule.needs) <= since if rule.needs else F.lit(False)
        has = last(rule.forbids) > since if rule.forbids else F.lit(False)
        return F.when((F.col(event) == rule.event) & (lacks | has), rule.name)

    found = rows.withColumn("rule", F.coalesce(*map(broken, rules))).where("rule IS NOT NULL")
    cols = [key, *order, event, "rule"]
    if not first:
        return found.select(*dict.fromkeys(cols))
    return found.groupBy(key).agg(F.min_by(F.struct(*dict.fromkeys(c for c in cols if c != key)), "_at").alias("x")).select(key, "x.*")


def register() -> None:
    from ..sources import panel as source
    from .queries import query

    #: The log of users: a purchase needs a view since the last error, an error must not follow another one with nothing between, and a click needs a signup at any time before.
    shop = (Rule("purchase without view", "purchase", needs=("view",), since=("error", "purchase")), Rule("click before signup", "click", needs=("signup",)), Rule("error after error", "error", forbids=("error",), since=("view", "click", "purchase", "signup")))
    last = ", ".join(f"coalesce(max(CASE WHEN event_type = '{e}' THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l_{e}" for e in ("view", "click", "purchase", "signup", "error"))
    state = f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), l AS (SELECT *, {last} FROM n), b AS (SELECT user_id, ts, event_id, event_type, k, CASE WHEN event_type = 'purchase' AND l_view <= greatest(l_error, l_purchase) THEN 'purchase without view' WHEN event_type = 'click' AND l_signup = 0 THEN 'click before signup' WHEN event_type = 'error' AND l_error > greatest(l_view, l_click, l_purchase, l_signup) THEN 'error after error' END AS rule FROM l)"

    @query("event_order", f"{state} SELECT user_id, event_id, event_type, rule FROM b WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) = 1")
    def event_order(spark, sf_dir):
        return violations(source.read(spark, sf_dir, "events"), shop, "user_id", ("ts", "event_id"), "event_type").drop("ts")

    @query("event_order_all", f"{state} SELECT rule, count(*) AS n, count(DISTINCT user_id) AS n_users FROM b WHERE rule IS NOT NULL GROUP BY 1")
    def event_order_all(spark, sf_dir):
        return violations(source.read(spark, sf_dir, "events"), shop, "user_id", ("ts", "event_id"), "event_type", first=False).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))
