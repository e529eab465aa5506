"""State kept as append-only tables: the trial ledger, lessons, allocation among families, lineage, and a book of factors. The newest row of a key is its state."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ledger import PEEKS, PeekBudget  # noqa: F401

#: Fixed values of the lesson fold and the allocation.
ALPHA, VETO_SEEN, VETO_FAILED, TEMPERATURE, FLOOR = 0.5, 3, 2, 0.5, 0.05


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    cols = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_b"))
    return best.select(key, "_b.*")


def replace(book: DataFrame, new: DataFrame, key: str = "factor") -> DataFrame:
    """The book without the keys of ``new``, and ``new``; rows without a value go."""
    return book.join(new.select(key).distinct(), key, "left_anti").unionByName(new).where("value IS NOT NULL")


def irs(trials: DataFrame) -> DataFrame:
    """trial_id, thesis_id, ir: t / sqrt(n) of the rows that count as trials."""
    return trials.where("counts_as_trial = 1 AND n_days > 0").select("trial_id", "thesis_id", (F.col("t_stat") / F.sqrt("n_days")).alias("ir"))


def effective_running(rows: DataFrame) -> DataFrame:
    """Per trial the running effective count (sum of |ir|)^2 / sum of ir^2 within its thesis."""
    w = Window.partitionBy("thesis_id").orderBy("trial_id").rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum(F.abs("ir")).over(w)
    return rows.withColumn("effective", F.try_divide(s * s, F.sum(F.col("ir") * F.col("ir")).over(w)))


def lessons(outcomes: DataFrame) -> DataFrame:
    """Of outcomes (motif, seq, helped, confident): the exponential mean of helped in order of seq, its reliability, counts and veto. The fold's weights depend on the place from the end alone, so no list is gathered."""
    w = Window.partitionBy("motif")
    k = F.row_number().over(w.orderBy(F.desc("seq"))) - 1
    n = F.count("*").over(w)
    d = outcomes.withColumns({"_k": k, "_n": n})
    weight = F.when(F.col("_k") == F.col("_n") - 1, F.pow(F.lit(1 - ALPHA), F.col("_k"))).otherwise(ALPHA * F.pow(F.lit(1 - ALPHA), F.col("_k")))
    failed = F.col("helped") < 0.5
    out = d.groupBy("motif").agg(F.sum(F.col("helped") * weight).alias("p_helps"), F.count("*").alias("n_observations"), F.count_if(failed).alias("n_failures"), F.count_if(failed & F.col("confident")).alias("n_conf_failures"))
    return out.withColumns({"confidence": F.abs(2 * F.col("p_helps") - 1) * (1 - F.pow(F.lit(0.5), "n_observations")), "veto": (F.col("n_observations") >= VETO_SEEN) & (F.col("n_conf_failures") >= VETO_FAILED)})


def allocation(rewards: DataFrame) -> DataFrame:
    """Of (family, reward): pulls, mean reward and share: a softmax of means with a floor."""
    f = rewards.groupBy("family").agg(F.count("*").alias("n_pulls"), F.avg("reward").alias("mean_reward"))
    top = f.agg(F.max("mean_reward").alias("_top"), F.count("*").alias("_m"))
    f = f.crossJoin(top).withColumn("_e", F.exp((F.col("mean_reward") - F.col("_top")) / TEMPERATURE))
    total = f.agg(F.sum("_e").alias("_all"))
    return f.crossJoin(total).select("family", "n_pulls", "mean_reward", (FLOOR + (1 - FLOOR * F.col("_m")) * F.col("_e") / F.col("_all")).alias("share"))


def lineage(cards: DataFrame, depth: int | None = None) -> DataFrame:
    """Of (card_id, parent_id): card_id, ancestor, steps. A path ends at a card without parent, and before a card that it has already passed, so a cycle ends; with a depth, at that many steps instead.

    Paths are put together from paths: a round joins those of exactly n steps with all of up to n, each written once, so a path of n steps takes log2(n) rounds and no count of rows is a limit."""
    times = F.count("*").over(Window.partitionBy("card_id"))  # a card with more parents begins as many times
    edges = cards.withColumn("_times", times).where("card_id IS NOT NULL AND parent_id IS NOT NULL")
    if depth is None:
        edges = edges.where("card_id <> parent_id")
    part = staged(edges.select("card_id", "_times", F.col("parent_id").alias("ancestor"), F.lit(1).alias("steps"), F.array("parent_id").alias("path")))
    parts, reach = [part], 1
    while (depth is None or reach < depth) and not (far := part.where(F.col("steps") == reach)).isEmpty():
        on = reduce(DataFrame.unionByName, parts).select(F.col("card_id").alias("_at"), F.col("ancestor").alias("_ancestor"), F.col("steps").alias("_steps"), F.col("path").alias("_path"))
        more = far.join(on, F.col("ancestor") == F.col("_at"))
        more = more.where("NOT array_contains(_path, card_id) AND NOT arrays_overlap(path, _path)") if depth is None else more.where(F.col("steps") + F.col("_steps") <= depth)
        part = staged(more.select("card_id", "_times", F.col("_ancestor").alias("ancestor"), (F.col("steps") + F.col("_steps")).alias("steps"), F.concat("path", "_path").alias("path")))
        parts, reach = [*parts, part], 2 * reach
    paths = reduce(DataFrame.unionByName, parts).withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    if depth is not None:
        paths = paths.where(F.col("steps") <= depth)
    return cards.select("card_id", F.col("card_id").alias("ancestor"), F.lit(0).alias("steps")).unionByName(paths.select("card_id", "ancestor", "steps"))


def keyword_score(text: Column, words: list[str]) -> Column:
    """How many of the words a text has, case aside."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def rates(rows: DataFrame) -> DataFrame:
    """Of (gate, genuine, passed): how much junk each gate catches, how many genuine signals it kills, and the false share of what it lets through."""
    junk, good = F.col("genuine") == 0, F.col("genuine") == 1
    passed = F.col("passed")
    return rows.groupBy("gate").agg(F.avg(F.when(junk, (~passed).cast("double"))).alias("catch_rate"), F.avg(F.when(good, (~passed).cast("double"))).alias("false_kill"), F.try_divide(F.count_if(junk & passed), F.count_if(passed)).alias("fdr"), F.count("*").alias("n"))


def register() -> None:
    from ..functions.stats import expected_max_sharpe
    from ..sources import panel as source
    from . import formula
    from .queries import query, r
    from .zoo import ZOO

    # trials are drawn from events in a fixed way
    trials_sql = "trials AS (SELECT event_id AS trial_id, user_id % 7 AS thesis_id, value AS t_stat, 50 + event_id % 200 AS n_days, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS counts_as_trial, event_type FROM events)"

    def trials(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        return e.select(F.col("event_id").alias("trial_id"), (F.col("user_id") % 7).alias("thesis_id"), F.col("value").alias("t_stat"), (50 + F.col("event_id") % 200).alias("n_days"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("counts_as_trial"), "event_type")

    irs_sql = "irs AS (SELECT trial_id, thesis_id, t_stat / sqrt(n_days) AS ir FROM trials WHERE counts_as_trial = 1)"

    @query("trial_irs", f"WITH {trials_sql}, {irs_sql} SELECT trial_id, thesis_id, round(ir, 6) AS ir FROM irs")
    def trial_irs(spark, sf_dir):
        return irs(trials(spark, sf_dir)).withColumn("ir", r("ir"))

    @query("ledger_summary", f"WITH {trials_sql}, {irs_sql} SELECT trial_id, thesis_id, round(sum(abs(ir)) OVER w * sum(abs(ir)) OVER w / nullif(sum(ir * ir) OVER w, 0), 4) AS effective FROM irs WINDOW w AS (PARTITION BY thesis_id ORDER BY trial_id)")
    def ledger_summary(spark, sf_dir):
        return effective_running(irs(trials(spark, sf_dir))).select("trial_id", "thesis_id", r("effective", 4).alias("effective"))

    @query("ledger_counts", f"WITH {trials_sql} SELECT thesis_id, count(*) AS n_rows, sum(counts_as_trial) AS n_trials, round(max(t_stat), 6) AS best_t FROM trials GROUP BY 1")
    def ledger_counts(spark, sf_dir):
        return trials(spark, sf_dir).groupBy("thesis_id").agg(F.count("*").alias("n_rows"), F.sum("counts_as_trial").cast("decimal(38,0)").alias("n_trials"), r(F.max("t_stat")).alias("best_t")).withColumn("n_trials", F.col("n_trials").cast("long"))

    @query("rolling_fdr", f"WITH {trials_sql} SELECT trial_id, thesis_id, round(avg(CASE WHEN t_stat < 20 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY thesis_id ORDER BY trial_id ROWS 5 PRECEDING), 6) AS fdr FROM trials WHERE counts_as_trial = 1")
    def rolling_fdr(spark, sf_dir):
        w = Window.partitionBy("thesis_id").orderBy("trial_id").rowsBetween(-5, 0)
        return trials(spark, sf_dir).where("counts_as_trial = 1").select("trial_id", "thesis_id", r(F.avg((F.col("t_stat") < 20).cast("double")).over(w)).alias("fdr"))

    outcomes_sql = "o AS (SELECT user_id % 50 AS motif, event_id AS seq, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS helped, event_id % 2 = 0 AS confident FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY seq DESC) - 1 AS k, count(*) OVER (PARTITION BY motif) AS n FROM o)"

    @query("lesson_state", f"WITH {outcomes_sql}, f AS (SELECT motif, sum(helped * CASE WHEN k = n - 1 THEN pow(0.5, k) ELSE 0.5 * pow(0.5, k) END) AS p, count(*) AS c, count(*) FILTER (helped < 0.5) AS bad, count(*) FILTER (helped < 0.5 AND confident) AS conf FROM n GROUP BY motif) SELECT motif, round(p, 6) AS p_helps, c AS n_observations, bad AS n_failures, conf AS n_conf_failures, round(abs(2 * p - 1) * (1 - pow(0.5, c)), 6) AS confidence, c >= 3 AND conf >= 2 AS veto FROM f")
    def lesson_state(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        o = e.select((F.col("user_id") % 50).alias("motif"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("helped"), (F.col("event_id") % 2 == 0).alias("confident"))
        return lessons(o).withColumns({"p_helps": r("p_helps"), "confidence": r("confidence")})

    @query("bandit_alloc", "WITH f AS (SELECT event_type AS family, count(*) AS n_pulls, avg(value / 100) AS m FROM events GROUP BY 1), e AS (SELECT *, exp((m - (SELECT max(m) FROM f)) / 0.5) AS e FROM f) SELECT family, n_pulls, round(m, 6) AS mean_reward, round(0.05 + (1 - 0.05 * count(*) OVER ()) * e / sum(e) OVER (), 6) AS share FROM e")
    def bandit_alloc(spark, sf_dir):
        out = allocation(source.read(spark, sf_dir, "events").select(F.col("event_type").alias("family"), (F.col("value") / 100).alias("reward")))
        return out.withColumns({"mean_reward": r("mean_reward"), "share": r("share")})

    @query("lineage_path", "WITH RECURSIVE cards AS (SELECT p_partkey AS card_id, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent_id FROM part), up(card_id, ancestor, steps) AS (SELECT card_id, card_id, 0 FROM cards UNION ALL SELECT u.card_id, c.parent_id, u.steps + 1 FROM up u JOIN cards c ON c.card_id = u.ancestor WHERE c.parent_id IS NOT NULL) SELECT * FROM up")
    def lineage_path(spark, sf_dir):
        part = source.read(spark, sf_dir, "part")
        return lineage(part.select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3).cast("long")).alias("parent_id")))

    @query("latest_state", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
    def latest_state(spark, sf_dir):
        e = source.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", r("value").alias("value"))
        return latest(e, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")

    words = ["momentum", "thing", "tion", "reversal", "and"]

    @query("corpus_retrieval", "SELECT doc_id, hits, CAST(row_number() OVER (ORDER BY hits DESC, doc_id) AS INTEGER) AS place FROM (SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words) + " AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 25")
    def corpus_retrieval(spark, sf_dir):
        d = source.read(spark, sf_dir, "documents").select("doc_id", keyword_score(F.col("text"), words).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(25)
        return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), "doc_id")))

    @query("corpus_family_counts", "SELECT lang AS family, count(*) AS n, sum(CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) AS tradeable FROM documents GROUP BY 1")
    def corpus_family_counts(spark, sf_dir):
        return source.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("family")).agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("tradeable"))

    @query("gate_rates", "WITH g AS (SELECT quality AS genuine, UNNEST([{'gate': 'novelty', 'passed': doc_id % 3 > 0 OR quality = 1}, {'gate': 'statistics', 'passed': doc_id % 5 > 1}, {'gate': 'redteam', 'passed': toxic = 0}]) AS x FROM labels) SELECT x.gate AS gate, round(avg(CASE WHEN genuine = 0 THEN CASE WHEN x.passed THEN 0.0 ELSE 1.0 END END), 6) AS catch_rate, round(avg(CASE WHEN genuine = 1 THEN CASE WHEN x.passed THEN 0.0 ELSE 1.0 END END), 6) AS false_kill, round(count(*) FILTER (genuine = 0 AND x.passed) / CAST(nullif(count(*) FILTER (x.passed), 0) AS DOUBLE), 6) AS fdr, count(*) AS n FROM g GROUP BY 1")
    def gate_rates(spark, sf_dir):
        x = source.read(spark, sf_dir, "labels")
        gates_ = {"novelty": (F.col("doc_id") % 3 > 0) | (F.col("quality") == 1), "statistics": F.col("doc_id") % 5 > 1, "redteam": F.col("toxic") == 0}
        long = x.select(F.col("quality").alias("genuine"), F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in gates_.items()))).alias("g")).select("genuine", "g.gate", "g.passed")
        return rates(long).withColumns({k: r(k) for k in ("catch_rate", "false_kill", "fdr")})

    @query("rejections_pivot", f"WITH {trials_sql} SELECT thesis_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM trials GROUP BY 1")
    def rejections_pivot(spark, sf_dir):
        kinds = ["click", "view", "purchase"]
        return trials(spark, sf_dir).groupBy("thesis_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)

    @query("oversearching_curve")
    def oversearching_curve(spark, sf_dir):
        """Expected best of n noise trials: sqrt(2 ln n), the extreme-value form, and a Monte-Carlo mean."""
        from ..sources.synthetic import normal

        ns = (5, 20, 100, 200, 500)
        known = spark.createDataFrame([(n, math.sqrt(2 * math.log(n)), expected_max_sharpe(n)) for n in ns], "n int, bound double, expected double")
        draws = spark.range(2000).select("id", F.explode(F.array(*map(F.lit, ns))).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("z", normal(42, "id", "n", "k"))
        return known.join(draws.groupBy("n", "id").agg(F.max("z").alias("z")).groupBy("n").agg(F.avg("z").alias("simulated")), "n")

    @query("formula_index")
    def formula_index(spark, sf_dir):
        """Every known formula's canonical text, hash, fingerprint, structural key, complexity and fields."""
        rows = [(k, formula.canonical(f), formula.formula_hash(f), formula.fingerprint(f), formula.structural_key(f), *formula.complexity(f).values(), formula.fields(f)) for k, f in ZOO.items()]
        return spark.createDataFrame(rows, "name string, canonical string, formula_hash string, fingerprint string, structural_key string, nodes int, depth int, free_params int, fields array<string>")
