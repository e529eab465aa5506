"""The deterministic side of a research loop: prefilter, tiers, gates and cards for formulas that someone proposes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import backtest
from .formula import EvalError, ParseError, canonical, checked, complexity, evaluate, fields, parse
from .zoo import zoo_duplicate

#: Caps of nodes, depth and literals; stages of the curriculum; what raises the gates.
CAPS = {"nodes": 40, "depth": 12, "free_params": 10}
CURRICULUM = 4
TIGHTEN_AT, TIGHTER_T, TIGHTER_IC = 0.33, 0.5, 0.005


def prefilter(formula: str, seen: set[str]) -> str | None:
    """Why a formula is not worth a backtest; null where it is."""
    try:
        tree = parse(formula)
    except ParseError:
        return "parse_error"
    size = complexity(tree)
    if any(size[k] > most for k, most in CAPS.items()):
        return "too_complex"
    if zoo_duplicate(formula):
        return "known_formula"
    if canonical(formula) in seen:
        return "repeated"
    try:
        checked(tree)
    except EvalError:
        return "eval_error"
    return None


def preregister(thesis: dict) -> str:
    """A thesis's hash, taken before anything is tested."""
    return hashlib.sha256(json.dumps(thesis, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stage(generation: int, every: int = 3) -> int:
    return (generation // every) % CURRICULUM


def tightened(fdr: float, t_bar: float, min_ic: float) -> tuple[float, float]:
    return (t_bar + TIGHTER_T, min_ic + TIGHTER_IC) if fdr > TIGHTEN_AT else (t_bar, min_ic)


def exhausted(best: list[float], k: int = 3, least: float = 1e-3) -> bool:
    """Whether the last k generations brought no gain worth having."""
    return len(best) > k and max(best[-k:]) - max(best[:-k]) < least


def best_delta(scores: DataFrame) -> DataFrame:
    """Of (thesis_id, variant, ic): what the best of two or more variants has over the first."""
    g = scores.groupBy("thesis_id").agg(F.max("ic").alias("best"), F.min_by("ic", "variant").alias("first"), F.count("*").alias("n"))
    return g.where("n >= 2").select("thesis_id", (F.col("best") - F.col("first")).alias("delta"))


def thesis_gate(scores: Column, texts: Column) -> Column:
    """passed where no text of the rubric is blank and no score is zero or less."""
    blank = F.exists(texts, lambda x: x.isNull() | (F.trim(x) == ""))
    return ~F.coalesce(blank, F.lit(True)) & ~F.coalesce(F.exists(scores, lambda x: x.isNull() | (x <= 0)), F.lit(True))


def score(rows: DataFrame, formulas: dict[str, str], split: str = "val_a", label: str = "fwd_ret_5_demeaned", least: int = 20) -> DataFrame:
    """name, mean_ic, sd_ic, icir, t_stat, n_days, sign of many formulas in one plan."""
    backtest.guard(split)
    wide = evaluate(rows, formulas, ("date", "symbol", label)).where(backtest.in_split(split))
    long = wide.select("date", label, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("sig")) for k in formulas))).alias("x")).select("date", label, "x.name", "x.sig")
    return stats.ic_summary(stats.daily_ic(long, "sig", label, least=least, keys=("name", "date")), "name")


@dataclass
class Generation:
    """What one round did: rejected formulas with reasons, scores of the others, and the promoted ones."""

    rejected: dict[str, str] = field(default_factory=dict)
    scores: dict[str, dict] = field(default_factory=dict)
    promoted: list[str] = field(default_factory=list)
    events: list[str] = field(default_factory=list)


def run_generation(rows: DataFrame, proposals: Iterable[str], seen: set[str], min_ic: float = 0.01, min_t: float = 2.0) -> Generation:
    """Prefilter, first tier on val_a, second tier on val_b for those promoted; both tiers are one plan for all formulas."""
    g, ready = Generation(), {}
    for f in proposals:
        reason = prefilter(f, seen)
        if reason:
            g.rejected[f] = reason
        else:
            seen.add(canonical(f))
            ready[f"f{len(ready)}"] = f
    if not ready:
        return g
    g.events.append("val_a")
    for r in score(rows, ready).collect():
        g.scores[ready[r.name]] = {"val_a": r.mean_ic, "t": r.t_stat, "n_days": r.n_days, "sign": r.sign}
    strong = {k: f for k, f in ready.items() if f in g.scores and abs(g.scores[f]["val_a"] or 0) >= min_ic and abs(g.scores[f]["t"] or 0) >= min_t}
    g.rejected |= {f: "weak" for k, f in ready.items() if k not in strong}
    if strong:
        g.events.append("val_b")
        for r in score(rows, strong, "val_b").collect():
            g.scores[strong[r.name]]["val_b"] = r.mean_ic
            if r.mean_ic * g.scores[strong[r.name]]["val_a"] > 0:
                g.promoted.append(strong[r.name])
        g.rejected |= {f: "not_repeated" for f in strong.values() if f not in g.promoted}
    return g


def ordered_events(events: DataFrame, first: str, then: str) -> DataFrame:
    """Of (thesis_id, seq, event): theses in which ``then`` came before ``first``, or without it."""
    at = events.groupBy("thesis_id").agg(F.min(F.when(F.col("event") == first, F.col("seq"))).alias("a"), F.min(F.when(F.col("event") == then, F.col("seq"))).alias("b"))
    return at.where("b IS NOT NULL AND (a IS NULL OR b < a)").select("thesis_id")


def formula_table(spark: SparkSession, formulas: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, f, *complexity(f).values(), fields(f)) for k, f in formulas.items()], "name string, formula string, nodes int, depth int, free_params int, fields array<string>")


# ablation

GATES = ("novelty", "statistics", "redteam")


def signal_pool(rows: DataFrame, seed: int = 42, draws: int = 20) -> DataFrame:
    """date, symbol, signal_id, kind, sig: genuine, noise, leaky and overfit (best of many draws on the train years) signals on labelled rows."""
    from ..sources.synthetic import normal

    y = F.coalesce(F.col("fwd_ret_1_demeaned"), F.lit(0.0))
    z = F.coalesce(F.try_divide(y, F.stddev_pop("fwd_ret_1_demeaned").over(Window.partitionBy("date"))), F.lit(0.0))
    base = rows.select("date", "symbol", "fwd_ret_1_demeaned", z.alias("z"))
    kinds = {"genuine": 0.2 * F.col("z") + 0.98 * normal(seed, "symbol", "date"), "noise": normal(seed + 1, "symbol", "date"), "leaky": 0.85 * F.col("z") + 0.15 * normal(seed + 2, "symbol", "date")}
    fixed = base.select("date", "symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("sig")) for k, v in kinds.items()))).alias("x")).select("date", "symbol", F.col("x.kind").alias("signal_id"), "x.kind", "x.sig")
    tries = base.select("date", "symbol", "fwd_ret_1_demeaned", F.explode(F.array(*map(F.lit, range(draws)))).alias("draw")).withColumn("sig", normal(seed + 3, "symbol", "date", "draw"))
    ics = stats.daily_ic(tries.where(backtest.in_split("train")), "sig", "fwd_ret_1_demeaned", keys=("draw", "date")).groupBy("draw").agg(F.avg("ic").alias("ic"))
    best = ics.agg(F.max_by("draw", "ic").alias("draw"))
    return fixed.unionByName(tries.join(best, "draw").select("date", "symbol", F.lit("overfit").alias("signal_id"), F.lit("overfit").alias("kind"), "sig"))


def ablation(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """signal_id, kind, statistics, redteam: whether each passes the statistics gate (t on val_a) and the lag test, all signals scored at once."""
    lab = rows.select("date", "symbol", "pos", "fwd_ret_1_demeaned")
    long = pool.join(lab, ["date", "symbol"]).withColumn("late", F.lag("sig", 1).over(Window.partitionBy("signal_id", "symbol").orderBy("pos"))).where(backtest.in_split("val_a"))
    now = stats.ic_summary(stats.daily_ic(long, "sig", "fwd_ret_1_demeaned", keys=("signal_id", "date")), "signal_id").select("signal_id", F.col("t_stat").alias("t"), F.col("mean_ic").alias("ic"))
    late = stats.ic_summary(stats.daily_ic(long, "late", "fwd_ret_1_demeaned", keys=("signal_id", "date")), "signal_id").select("signal_id", F.col("mean_ic").alias("late_ic"))
    kinds = pool.select("signal_id", "kind").distinct()
    return kinds.join(now, "signal_id").join(late, "signal_id", "left").select("signal_id", "kind", "ic", "t", "late_ic", (F.col("t") >= 3).alias("statistics"), (F.col("ic") < 0.5).alias("redteam"))


KINDS = ("genuine", "noise", "overfit", "leaky")


def world_pool(w: DataFrame, per_kind: int = 10, draws: int = 100, seed: int = 42) -> DataFrame:
    """place, signal_id, kind, date, pos, symbol, fwd_ret_1_demeaned, sig on an AR(1) world: per_kind signals of each kind, dealt in turns. A genuine one is the latent with a little noise, a leak the scored label itself with either sign, an overfit one the best of many noise draws on the scored days."""
    from ..sources.synthetic import normal

    y, base = F.col("fwd_ret_1_demeaned"), ("date", "pos", "symbol", "fwd_ret_1_demeaned")
    z = lambda k, i: normal(seed + k, F.lit(i), "symbol", "pos")
    made = []
    for i in range(per_kind):
        part = i / max(per_kind - 1, 1)
        made += [("genuine", i, (0.3 + 1.2 * part) * F.col("latent") + (0.05 + 0.3 * (1 - part)) * z(1, i)), ("noise", i, z(2, i)), ("leaky", i, (1 if i % 2 == 0 else -1) * y / 0.02 + (0.02 + 0.01 * i) * z(3, i))]
    fixed = w.select(*base, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i"), v.alias("sig")) for k, i, v in made))).alias("x")).select(*base, "x.*")
    draw = normal(seed + 4, "draw", "symbol", "pos")
    tries = w.select(*base, F.explode(F.sequence(F.lit(0), F.lit(per_kind * draws - 1))).alias("draw")).withColumn("sig", draw)
    means = stats.daily_ic(tries, "sig", "fwd_ret_1_demeaned", keys=("draw", "date")).groupBy("draw").agg(F.avg("ic").alias("ic"))
    best = means.groupBy(F.floor(F.col("draw") / draws).cast("int").alias("i")).agg(F.max_by("draw", "ic").alias("draw"))
    worst = w.select(*base).crossJoin(F.broadcast(best)).select(*base, F.lit("overfit").alias("kind"), "i", draw.alias("sig"))  # a row per signal
    kinds = F.array(*map(F.lit, KINDS))
    return fixed.unionByName(worst).select((F.col("i") * len(KINDS) + F.array_position(kinds, F.col("kind")) - 1).cast("int").alias("place"), F.concat_ws("_", "kind", F.col("i").cast("string")).alias("signal_id"), "kind", *base, "sig")


def world_ablation(pool: DataFrame, least: int = 20) -> DataFrame:
    """place, signal_id, kind, sign, ic, t, dsr, late_ic, novelty, statistics, redteam: all signals scored in one plan, then what each of the three gates says by itself. The deflated Sharpe ratio of a signal counts those before it as trials; the last gate is the lag of a day."""
    from ..functions.stats import deflated_sharpe, expected_max_sharpe
    from . import gates, redteam

    d = pool.withColumn("late", F.lag("sig").over(Window.partitionBy("signal_id", "symbol").orderBy("pos")))
    keys = ("place", "signal_id", "kind")
    long = d.select(*keys, "date", "fwd_ret_1_demeaned", F.explode(F.array(*(F.struct(F.lit(k).alias("late"), F.col(c).alias("s")) for k, c in ((False, "sig"), (True, "late"))))).alias("x")).select(*keys, "date", "fwd_ret_1_demeaned", "x.late", "x.s")
    found = stats.moments(stats.daily_ic(long, "s", "fwd_ret_1_demeaned", least=least, keys=(*keys, "late", "date")), "ic", *keys, "late").collect()  # two rows a signal
    now, late = ({r.signal_id: r for r in found if r.late == k} for k in (False, True))
    t = lambda r: r["mean"] * r.n**0.5 / r.sd if r is not None and r.sd else 0.0
    out = []
    for k, r in now.items():
        sign, n = (1 if r["mean"] > 0 else -1), r.n
        ic, after = abs(r["mean"]), sign * late[k]["mean"] if k in late else 0.0
        ok = n >= 4 and r.sd
        dsr = deflated_sharpe(ic / r.sd, n, sign * r["skew"], r.kurt, expected_max_sharpe(r.place + 1, n**-0.5)) if ok else 0.0
        passed = n >= gates.MIN_DAYS and dsr >= gates.MIN_DSR and abs(t(r)) >= gates.MIN_T
        lost = after <= 0 or after < redteam.COLLAPSE * ic or abs(t(late.get(k))) < redteam.WEAK_T
        out.append((r.place, k, r.kind, sign, ic, t(r), dsr, after, ic >= gates.MIN_MARGINAL_IC, passed, not lost))
    return pool.sparkSession.createDataFrame(out, "place int, signal_id string, kind string, sign int, ic double, t double, dsr double, late_ic double, novelty boolean, statistics boolean, redteam boolean")


def register() -> None:
    from ..sources import panel as source
    from .queries import query, r

    @query("loop_generation")
    def loop_generation(spark, sf_dir):
        """A scripted round: formula, outcome, score."""
        rows = source.fwd_labels(source.panel(spark, sf_dir))
        asked = ["rank(mul(-1, delta(close, 5)))", "close.x", "mul(-1, ts_rank(rank(low), 9))", "ts_mean(close)", "rank(mul(-1, delta(close, 5)))", "rank(div(sub(high, close), sub(high, low)))", "rank(sub(vwap, close))"]
        g = run_generation(rows, asked, set())
        out = [(f, "promoted" if f in g.promoted else g.rejected.get(f, ""), (g.scores.get(f) or {}).get("val_a")) for f in dict.fromkeys(asked)]
        return spark.createDataFrame(out, "formula string, outcome string, val_a_ic double").withColumn("val_a_ic", r("val_a_ic"))

    @query("best_delta", "SELECT user_id AS thesis_id, round(max(value) - arg_min(value, event_id), 6) AS delta FROM events GROUP BY 1 HAVING count(*) >= 2")
    def best_delta_(spark, sf_dir):
        tries = source.read(spark, sf_dir, "events").select(F.col("user_id").alias("thesis_id"), F.col("event_id").alias("variant"), F.col("value").alias("ic"))
        return best_delta(tries).withColumn("delta", r("delta"))

    @query("thesis_gate", "SELECT doc_id, coalesce(trim(text), '') <> '' AND coalesce(trim(lang), '') <> '' AND coalesce(trim(source), '') <> '' AND coalesce(quality, 0) > 0 AND coalesce(1 - toxic, 0) > 0 AS passed FROM documents LEFT JOIN labels USING (doc_id)")
    def thesis_gate_(spark, sf_dir):
        """A text with its language and source as a rubric, and its two labels as scores."""
        rows = source.read(spark, sf_dir, "documents").join(source.read(spark, sf_dir, "labels"), "doc_id", "left")
        return rows.select("doc_id", thesis_gate(F.array("quality", 1 - F.col("toxic")), F.array("text", "lang", "source")).alias("passed"))

    @query("ablation_scores")
    def ablation_scores(spark, sf_dir):
        rows = source.fwd_labels(source.panel(spark, sf_dir))
        out = ablation(rows, signal_pool(rows))
        return out.withColumns({k: r(k) for k in ("ic", "t", "late_ic")})

    @query("ablation_world")
    def ablation_world(spark, sf_dir):
        """Forty signals of four kinds on a synthetic world, and what each gate says of each."""
        from ..sources.synthetic import world

        out = world_ablation(world_pool(world(spark, 250, 24, edge=0.3)))
        return out.withColumns({k: r(k) for k in ("ic", "t", "dsr", "late_ic")})
