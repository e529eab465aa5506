"""What a research loop asks of its state: false discoveries among accepted cards, the next family, priors, cards and children, weights by regime, surrogates against overfitting, and the whole second gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_NAMES
from ..functions import stats
from . import backtest, gates, stores

#: Accepted cards that the false-discovery rate looks back on, observations that make a lesson a prior, least days of a regime, surrogates of a signal.
FDR_WINDOW, PRIOR_SEEN, REGIME_LEAST, SURROGATES = 6, 3, 30, 12


def accepted_fdr(generations: DataFrame, window: int = FDR_WINDOW) -> DataFrame:
    """Of (run, seq, verdict, holdout_failed): at each generation the share of the last accepted ones whose holdout failed, 0 before the first."""
    ok = F.coalesce(F.col("verdict") == "accept", F.lit(False))
    inside = Window.partitionBy("run", "_ok").orderBy("seq").rowsBetween(1 - window, 0)
    d = generations.withColumn("_ok", ok).withColumn("_at", F.when(F.col("_ok"), F.avg(F.coalesce(F.col("holdout_failed"), F.lit(False)).cast("double")).over(inside)))
    so_far = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("run", "seq", F.coalesce(F.last("_at", True).over(so_far), F.lit(0.0)).alias("fdr"))


def shares(families: DataFrame, rewards: DataFrame) -> DataFrame:
    """family, n_pulls, share of all families, also those without a pull (mean 0); equal shares where the floor alone would use up the whole."""
    f = families.select("family").distinct().join(rewards.groupBy("family").agg(F.count("*").alias("n_pulls"), F.avg("reward").alias("m")), "family", "left").fillna(0, ["n_pulls", "m"])
    f = f.crossJoin(f.agg(F.max("m").alias("_top"), F.count("*").alias("_n"))).withColumn("_e", F.exp((F.col("m") - F.col("_top")) / stores.TEMPERATURE))
    f = f.crossJoin(f.agg(F.sum("_e").alias("_all")))
    soft = stores.FLOOR + (1 - stores.FLOOR * F.col("_n")) * F.col("_e") / F.col("_all")
    return f.select("family", "n_pulls", F.when(F.col("_n") * stores.FLOOR >= 1, 1 / F.col("_n")).otherwise(soft).alias("share"))


def suggest(allocated: DataFrame, generations: DataFrame) -> DataFrame:
    """generation, family: the family to explore next. One never pulled comes first, then the largest share, then the fewest pulls; among equals, in order of their names, generations take turns. A row per family, ranked in one task."""
    s = F.round("share", 12)
    place = Window.orderBy(F.when(F.col("n_pulls") == 0, 0).otherwise(1), F.desc("_s"), "n_pulls")
    tied = allocated.withColumn("_s", s).withColumn("_r", F.rank().over(place)).where("_r = 1")
    tied = tied.select("family", (F.row_number().over(Window.orderBy("family")) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_m"))
    return generations.join(tied, F.pmod(generations.generation, F.col("_m")) == F.col("_i")).select("generation", "family")


def with_overrides(state: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lessons with vetoes lifted or forced by hand: of overrides (motif, seq, force) the newest of a motif decides, whatever is observed; a forced motif that nobody tried becomes a lesson."""
    o = stores.latest(overrides, "motif", "seq").select("motif", F.col("force").alias("_force"))
    d = state.join(o, "motif", "full")
    empty = {"p_helps": 0.0, "confidence": 1.0, "n_observations": 0, "n_failures": 0, "n_conf_failures": 0}
    new = F.col("veto").isNull()
    return d.where(~(new & ~F.coalesce("_force", F.lit(True)))).select("motif", *(F.when(new, F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in empty.items()), F.coalesce("_force", "veto").alias("veto"))


def priors(state: DataFrame, text: Column | None = None, words: Sequence[str] = ()) -> DataFrame:
    """Lessons seen often enough, not vetoed, whose text has any of the words; those likeliest to help first."""
    d = state.where((F.col("n_observations") >= PRIOR_SEEN) & ~F.col("veto"))
    if words:
        d = d.where(stores.keyword_score(text, list(words)) > 0)
    return d.orderBy(F.desc("p_helps"), F.desc("confidence"), F.desc("n_observations"), "motif")


def find_cards(cards: DataFrame, verdict: str | None = None, thesis_id: int | None = None) -> DataFrame:
    """Cards by verdict and thesis, oldest first."""
    for name, value in (("verdict", verdict), ("thesis_id", thesis_id)):
        if value is not None:
            cards = cards.where(F.col(name) == value)
    return cards.orderBy("created_at", "card_id")


def children(links: DataFrame) -> DataFrame:
    """Of (card_id, parent_id) a row per child: card_id, child. Rows and not lists, as a card may have any number."""
    return links.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("card_id"), F.col("card_id").alias("child")).distinct()


def retrieve(pool: DataFrame, text: Column, words: Sequence[str], order: str, limit: int) -> DataFrame:
    """The first ``limit`` entries by how many of the words they have, then by order; where none has any, the first of the pool."""
    top = pool.withColumn("hits", stores.keyword_score(text, list(words))).orderBy(F.desc("hits"), order).limit(limit)
    return top.withColumn("_most", F.max("hits").over(Window.partitionBy())).where("hits > 0 OR _most = 0").drop("_most")


def complete(ics: DataFrame, series: int) -> DataFrame:
    """Rows of those dates on which all of so many series have one. ics: name, date, ic."""
    return ics.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") == series).drop("_n")


def inverse_weights(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, name, weight of (keys, a, b, corr): in inverse proportion to the mean absolute correlation with the others."""
    raw = pairs.where("a <> b").groupBy(*keys, F.col("a").alias("name")).agg((1 / (F.avg(F.abs("corr")) + 1e-6)).alias("_w"))
    return raw.select(*keys, "name", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*keys))).alias("weight"))


def regime_gating(ics: DataFrame, series: int, regimes: DataFrame, names: Sequence[str], least: int = REGIME_LEAST, known: list[str] | None = None) -> DataFrame:
    """regime, n_days, gated, fixed, improves: the ICIR of a combination whose weights come from the regime's own days, and of one with the same weights always; regimes of fewer days go."""
    ics = complete(ics, series)
    fixed = inverse_weights(gates.pair_corr(ics, "date", "name", "ic", known)).withColumnRenamed("weight", "_fixed")
    tags = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in names)), lambda x: x.isNotNull())
    tagged = ics.join(regimes.select("date", F.explode(tags).alias("regime")), "date")
    own = inverse_weights(gates.pair_corr(tagged, "date", "name", "ic", known, "regime"), "regime")
    days = tagged.join(own, ["regime", "name"]).join(fixed, "name").groupBy("regime", "date").agg(F.sum(F.col("ic") * F.col("weight")).alias("g"), F.sum(F.col("ic") * F.col("_fixed")).alias("s"))
    icir = lambda c: F.try_divide(F.avg(c), F.stddev_samp(c))
    out = days.groupBy("regime").agg(F.count("*").alias("n_days"), icir("g").alias("gated"), icir("s").alias("fixed")).where(F.col("n_days") >= least)
    return out.withColumn("improves", F.coalesce(F.col("gated") > F.col("fixed"), F.lit(False)))


def surrogate_maps(symbols: DataFrame, n: int = SURROGATES) -> DataFrame:
    """k, symbol, target, flip: n permutations of the symbols with signs, by digests; k = 0 leaves all as it is. A row per symbol and surrogate."""
    s = symbols.select("symbol").distinct()
    tag = lambda kind: F.md5(F.concat_ws("|", F.lit(kind), F.col("k").cast("string"), "symbol").cast("binary"))
    d = s.crossJoin(s.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("k")))
    w = Window.partitionBy("k")
    d = d.withColumns({"_i": F.row_number().over(w.orderBy("symbol")), "_j": F.row_number().over(w.orderBy(tag("perm"), "symbol")), "flip": F.when(F.substring(tag("flip"), 1, 1) < "8", -1.0).otherwise(1.0)})
    moved = d.select("k", "symbol", "flip", "_i").join(d.select("k", F.col("symbol").alias("target"), F.col("_j").alias("_i")), ["k", "_i"]).select("k", "symbol", "target", "flip")
    return moved.unionByName(s.select(F.lit(0).alias("k"), "symbol", F.col("symbol").alias("target"), F.lit(1.0).alias("flip")))


def surrogate_pbo(rows: DataFrame, sig: str, label: str, n: int = SURROGATES, blocks: int = 8, purge: int = 5, least: int = MIN_NAMES) -> DataFrame:
    """pbo, n_splits: how often the best of a signal and its scrambles in half of the time is below the median in the other half. A genuine signal beats its scrambles in both."""
    moved = rows.select("date", "symbol", F.col(sig).alias("_s")).join(surrogate_maps(rows, n), "symbol").select("k", "date", F.col("target").alias("symbol"), F.round(F.col("_s") * F.col("flip"), 12).alias("s"))
    ics = stats.daily_ic(moved.join(rows.select("date", "symbol", label), ["date", "symbol"]), "s", label, least=least, keys=("k", "date"))
    ics = complete(ics.select(F.col("k").cast("string").alias("name"), "date", "ic"), n + 1)
    place = F.dense_rank().over(Window.orderBy("date")) - 1  # a row per date and scramble
    return gates.pbo(ics.select(place.cast("long").alias("t"), F.col("name").alias("strategy"), F.col("ic").alias("r")), blocks, purge)


def run_meta(state: DataFrame, *keys: str) -> DataFrame:
    """key, value of a run's one-row state: each of its keys as text, and how many cards it accepted."""
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    accepted = F.struct(F.lit("n_accepted").alias("key"), F.coalesce("accepted", F.lit(0)).cast("string").alias("value"))
    return state.select(F.explode(F.array(*pairs, accepted)).alias("x")).select("x.key", "x.value")


def token_budget(roles: DataFrame) -> DataFrame:
    """role, tier, calls_per_thesis, tokens_per_thesis of (role, tier, calls, tokens_per_call)."""
    return roles.select("role", F.coalesce("tier", F.lit("small")).alias("tier"), F.col("calls").cast("double").alias("calls_per_thesis"), F.round(F.col("calls") * F.col("tokens_per_call")).cast("long").alias("tokens_per_thesis"))


def register() -> None:
    from ..oracles import sql
    from ..sources import panel as source
    from .queries import _CSCV, _series_sql, LAB, REGIMES, SERIES, SIGNAL, ic_cte, labelled, query, r, regime_labels, series_ics, summary

    ran = "gen AS (SELECT user_id % 7 AS run, event_id AS seq, event_type = 'purchase' AS ok, value > 60 AS failed FROM events)"

    @query("accepted_fdr", f"WITH {ran}, x AS (SELECT *, CASE WHEN ok THEN avg(CASE WHEN failed THEN 1.0 ELSE 0 END) OVER (PARTITION BY run, ok ORDER BY seq ROWS 5 PRECEDING) END AS share FROM gen) SELECT run, seq, round(coalesce(last_value(share IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq), 0), 6) AS fdr FROM x")
    def accepted_fdr_(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        g = e.select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "accept").otherwise("reject").alias("verdict"), (F.col("value") > 60).alias("holdout_failed"))
        return accepted_fdr(g).withColumn("fdr", r("fdr"))

    fam = "pulls AS (SELECT 'f' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS family, value / 100 AS reward FROM events), fams AS (SELECT 'f' || lpad(CAST(k AS VARCHAR), 2, '0') AS family FROM range(15) t(k)), f AS (SELECT family, count(reward) AS n_pulls, coalesce(avg(reward), 0) AS m FROM fams LEFT JOIN pulls USING (family) GROUP BY 1)"
    one = "(SELECT generation, family FROM (SELECT family, row_number() OVER (ORDER BY family) - 1 AS i, count(*) OVER () AS m FROM (SELECT *, rank() OVER (ORDER BY CASE WHEN n_pulls = 0 THEN 0 ELSE 1 END, round(share, 12) DESC, n_pulls) AS k FROM (SELECT family, n_pulls, 0.05 + (1 - 0.05 * count(*) OVER ()) * exp(m / 0.5) / sum(exp(m / 0.5)) OVER () AS share FROM f {where})) WHERE k = 1) JOIN range(10) g(generation) ON generation % m = i)"

    @query("bandit_suggest", f"WITH {fam} SELECT 'all' AS pool, * FROM {one.format(where='')} UNION ALL SELECT 'pulled', * FROM {one.format(where='WHERE n_pulls > 0')}")
    def bandit_suggest(spark, sf_dir):
        name = lambda c: F.concat(F.lit("f"), F.lpad(c.cast("string"), 2, "0"))
        pulls = source.read(spark, sf_dir, "events").select(name(F.col("user_id") % 12).alias("family"), (F.col("value") / 100).alias("reward"))
        gens = spark.range(10).select(F.col("id").alias("generation"))
        every, pulled = (suggest(shares(f, pulls), gens) for f in (spark.range(15).select(name(F.col("id")).alias("family")), pulls))
        return every.select(F.lit("all").alias("pool"), "*").unionByName(pulled.select(F.lit("pulled").alias("pool"), "*"))

    folded = "o AS (SELECT user_id % 50 AS motif, event_id AS seq, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS helped, event_id % 4 = 0 AND user_id % 3 = 0 AS confident FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY seq DESC) - 1 AS k, count(*) OVER (PARTITION BY motif) AS n FROM o), f AS (SELECT motif, sum(helped * CASE WHEN k = n - 1 THEN pow(0.5, k) ELSE 0.5 * pow(0.5, k) END) AS p, count(*) AS c, count(*) FILTER (helped < 0.5 AND confident) >= 2 AND count(*) >= 3 AS veto FROM n GROUP BY 1)"
    hand = "h AS (SELECT DISTINCT ON (motif) p_partkey % 60 AS motif, p_size > 30 AS force FROM part ORDER BY motif, p_partkey DESC), s AS (SELECT motif, coalesce(p, 0) AS p, coalesce(c, 0) AS c, CASE WHEN f.motif IS NULL THEN 1 ELSE abs(2 * p - 1) * (1 - pow(0.5, c)) END AS conf, coalesce(force, veto) AS veto FROM f FULL JOIN h USING (motif) WHERE f.motif IS NOT NULL OR force)"

    def lessons_(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        o = e.select((F.col("user_id") % 50).alias("motif"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("helped"), ((F.col("event_id") % 4 == 0) & (F.col("user_id") % 3 == 0)).alias("confident"))
        h = source.read(spark, sf_dir, "part").select((F.col("p_partkey") % 60).alias("motif"), F.col("p_partkey").alias("seq"), (F.col("p_size") > 30).alias("force"))
        return with_overrides(stores.lessons(o), h)

    @query("lesson_overrides", f"WITH {folded}, {hand} SELECT motif, round(p, 6) AS p_helps, c AS n_observations, round(conf, 6) AS confidence, veto FROM s")
    def lesson_overrides(spark, sf_dir):
        return lessons_(spark, sf_dir).select("motif", r("p_helps").alias("p_helps"), "n_observations", r("confidence").alias("confidence"), "veto")

    @query("lesson_priors", f"WITH {folded}, {hand} SELECT motif, round(p, 6) AS p_helps, c AS n_observations FROM s WHERE c >= 3 AND NOT veto AND (contains('motif ' || motif || '.', '1') OR contains('motif ' || motif || '.', '7.')) ORDER BY s.p DESC, conf DESC, c DESC, motif")
    def lesson_priors(spark, sf_dir):
        text = F.concat(F.lit("Motif "), F.col("motif").cast("string"), F.lit("."))
        return priors(lessons_(spark, sf_dir), text, ("1", "7.")).select("motif", r("p_helps").alias("p_helps"), "n_observations")

    def cards_(spark, sf_dir):
        p = source.read(spark, sf_dir, "part")
        return p.select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3).cast("long")).alias("parent_id"), F.when(F.col("p_size") > 25, "accept").otherwise("reject").alias("verdict"), (F.col("p_partkey") % 9).alias("thesis_id"), F.col("p_size").alias("created_at"))

    @query("card_children", "SELECT p_partkey // 3 AS card_id, p_partkey AS child FROM part WHERE p_partkey >= 3")
    def card_children(spark, sf_dir):
        return children(cards_(spark, sf_dir))

    @query("cards_accepted", "SELECT p_partkey AS card_id, p_size AS created_at FROM part WHERE p_size > 25 AND p_partkey % 9 = 4 ORDER BY 2, 1")
    def cards_accepted(spark, sf_dir):
        return find_cards(cards_(spark, sf_dir), "accept", 4).select("card_id", "created_at")

    hits = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ("und", "der"))

    @query("corpus_fallback", f"(SELECT 'found' AS kind, doc_id, hits FROM (SELECT doc_id, {hits} AS hits FROM documents WHERE lower(lang) = 'de') WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 12) UNION ALL (SELECT 'none', doc_id, 0 FROM documents WHERE lower(lang) = 'de' ORDER BY doc_id LIMIT 12)")
    def corpus_fallback(spark, sf_dir):
        pool = source.read(spark, sf_dir, "documents").where(F.lower("lang") == "de").select("doc_id", "text")
        found, none = (retrieve(pool, F.col("text"), w, "doc_id", 12).select(F.lit(k).alias("kind"), "doc_id", "hits") for k, w in (("found", ("UND", "der")), ("none", ("zzqxzzq",))))
        return found.unionByName(none)

    tagged = "tagged AS (" + " UNION ALL ".join(f"SELECT full_.*, '{k}' AS regime FROM full_ JOIN regimes USING (date) WHERE {k}" for k in ("bull", "bear", "calm", "volatile", "highvol")) + ")"
    corr = "covar_samp(x.ic, y.ic) / nullif(stddev_samp(x.ic) * stddev_samp(y.ic), 0)"
    gating = [
        *_series_sql(), *REGIMES, f"full_ AS (SELECT * FROM ics WHERE date IN (SELECT date FROM ics GROUP BY 1 HAVING count(*) = {len(SERIES)}))", tagged,
        f"c0 AS (SELECT x.name AS name, avg(abs(c)) AS c FROM (SELECT x.name, y.name AS other, {corr} AS c FROM full_ x JOIN full_ y ON x.date = y.date AND x.name <> y.name GROUP BY 1, 2) x GROUP BY 1)",
        "w0 AS (SELECT name, (1 / (c + 1e-6)) / sum(1 / (c + 1e-6)) OVER () AS w FROM c0)",
        f"c1 AS (SELECT regime, name, avg(abs(c)) AS c FROM (SELECT x.regime, x.name, y.name AS other, {corr} AS c FROM tagged x JOIN tagged y ON x.date = y.date AND x.regime = y.regime AND x.name <> y.name GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        "w1 AS (SELECT regime, name, (1 / (c + 1e-6)) / sum(1 / (c + 1e-6)) OVER (PARTITION BY regime) AS w FROM c1)",
        "days AS (SELECT regime, date, sum(ic * w1.w) AS g, sum(ic * w0.w) AS s FROM tagged JOIN w1 USING (regime, name) JOIN w0 USING (name) GROUP BY 1, 2)",
    ]

    @query("regime_gating", sql.query(gating, f"SELECT regime, count(*) AS n_days, round(avg(g) / stddev_samp(g), 6) AS gated, round(avg(s) / stddev_samp(s), 6) AS fixed, avg(g) / stddev_samp(g) > avg(s) / stddev_samp(s) AS improves FROM days GROUP BY 1 HAVING count(*) >= {REGIME_LEAST}"))
    def regime_gating_(spark, sf_dir):
        out = regime_gating(series_ics(spark, sf_dir), len(SERIES), regime_labels(spark, sf_dir), ("bull", "bear", "calm", "volatile", "highvol"), known=SERIES)
        return out.withColumns({"gated": r("gated"), "fixed": r("fixed")})

    y = "fwd_ret_5_demeaned"
    scrambled = [
        *LAB, "names AS (SELECT DISTINCT symbol FROM sig)",
        "ord AS (SELECT k, symbol, row_number() OVER (PARTITION BY k ORDER BY symbol) AS i, row_number() OVER (PARTITION BY k ORDER BY md5('perm|' || k || '|' || symbol), symbol) AS j, CASE WHEN substr(md5('flip|' || k || '|' || symbol), 1, 1) < '8' THEN -1.0 ELSE 1.0 END AS flip FROM names CROSS JOIN range(1, 13) t(k))",
        "maps AS (SELECT a.k, a.symbol, b.symbol AS target, a.flip FROM ord a JOIN ord b ON a.k = b.k AND a.i = b.j UNION ALL SELECT 0, symbol, symbol, 1.0 FROM names)",
        f"moved AS (SELECT k, s.date, round(s.sig * flip, 12) AS s, l.{y} FROM sig s JOIN maps m ON m.symbol = s.symbol JOIN sig l ON l.date = s.date AND l.symbol = m.target WHERE {sql.split('val_a', 's.date')})",
        ic_cte("s", y, "moved", keys="k, date", least=MIN_NAMES),
        "tt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () // 8 AS q FROM (SELECT date FROM ics GROUP BY 1 HAVING count(*) = 13))",
        "strat AS (SELECT CAST(k AS VARCHAR) AS strategy, t, ic AS r FROM ics JOIN tt USING (date) WHERE t < 8 * q AND t % q >= 5)",
    ]

    @query("pbo_surrogates", sql.query([*scrambled, *_CSCV[2:]], "SELECT round(avg(CASE WHEN ln(p / (1 - p)) < 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_splits FROM best JOIN oos USING (m, strategy)"))
    def pbo_surrogates(spark, sf_dir):
        return summary(surrogate_pbo(labelled(spark, sf_dir).where(backtest.in_split("val_a")), "sig", y))

    @query("gate_b")
    def gate_b(spark, sf_dir):
        """The second gate on two cards, one after the other, with their trials and peeks: the plain reversal, and the coming return under three parts of noise, which must pass. val_b is the holdout here, so that the sealed days stay sealed."""
        import uuid

        from ..sources.staging import shared_dir, staged
        from ..sources.synthetic import normal
        from . import ledger, redteam, second_gate

        factors = {"mom": "sub(div(delay(close, 1), delay(close, 22)), 1)", "vol": "ts_std(returns, 21)"}
        rows = staged(labelled(spark, sf_dir, extra=factors).select("date", "symbol", "pos", "sig", "sector", "size_proxy", *factors, y))
        noisy = F.col(y) / F.stddev_samp(y).over(Window.partitionBy("date")) + 3 * normal(11, "symbol", "date")
        at = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
        trials, peeks = ledger.Trials(spark, f"{at}/trials"), ledger.PeekBudget(spark, f"{at}/peeks")
        out = []
        for card, sig in ((second_gate.Card("reversal", "prices", SIGNAL), F.col("sig")), (second_gate.Card("planted", "coming", "rank(delta(close, 1))"), noisy)):
            own = rows.withColumn("sig", sig)
            v = second_gate.judge(own, card, list(factors), trials, peeks, holdout="val_b")
            variants = {"extra_lag": F.lag("sig", 1).over(Window.partitionBy("symbol").orderBy("pos")), "sector_neutral": F.col("sig") - F.avg("sig").over(Window.partitionBy("date", "sector"))}
            long = own.withColumns(variants).where(backtest.in_split("val_a")).select("date", y, F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(k).alias("s")) for k in variants))).alias("x")).select("date", y, "x.variant", "x.s")
            second_gate.log_redteam(stats.daily_ic(long, "s", y, least=MIN_NAMES, keys=("variant", "date")), card, trials)
            a = v.audit
            out.append((card.card_id, v.passed, "; ".join(v.reasons), a["trial_id"], int(a["n_days"]), a.get("peek_id"), *(None if a.get(k) is None else float(a[k]) for k in ("marginal_ic", "t_stat", "deflated_sharpe", "n_trials_effective", "pbo", "holdout_ic"))))
        kept = trials.log.read().agg(F.count_if(F.col("counts_as_trial") == 1).alias("n_trials"), F.count_if(F.col("counts_as_trial") == 0).alias("n_rejecting"))
        schema = "card_id string, passed boolean, reasons string, trial_id long, n_days int, peek_id long, marginal_ic double, t_stat double, dsr double, effective_trials double, pbo double, holdout_ic double"
        found = spark.createDataFrame(out, schema).crossJoin(kept).withColumn("peeks_used", F.lit(peeks.used()).cast("long"))
        return found.withColumns({k: r(k) for k in ("marginal_ic", "t_stat", "dsr", "pbo", "holdout_ic")})

    @query("loop_run_meta", "SELECT unnest(['run_id', 'next_gen', 'large_used', 'n_accepted']) AS key, unnest([CAST(min(event_id) AS VARCHAR), CAST(count(*) + 1 AS VARCHAR), CAST(count(*) FILTER (event_type = 'view') AS VARCHAR), CAST(count(DISTINCT user_id) FILTER (event_type = 'purchase') AS VARCHAR)]) AS value FROM events")
    def loop_run_meta(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        state = e.agg(F.min("event_id").alias("run_id"), (F.count("*") + 1).alias("next_gen"), F.count_if(F.col("event_type") == "view").alias("large_used"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("accepted"))
        return run_meta(state, "run_id", "next_gen", "large_used")

    @query("agents_token_budget", "SELECT event_type AS role, CASE WHEN event_type IN ('click', 'view') THEN 'large' ELSE 'small' END AS tier, count(*) / CAST(count(DISTINCT user_id) AS DOUBLE) AS calls_per_thesis, CAST(round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE) * 1000) AS BIGINT) AS tokens_per_thesis FROM events GROUP BY 1")
    def agents_token_budget(spark, sf_dir):
        e = source.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role")).agg((F.count("*") / F.count_distinct("user_id")).alias("calls"))
        return token_budget(e.withColumns({"tier": F.when(F.col("role").isin("click", "view"), "large"), "tokens_per_call": F.lit(1000)}))
