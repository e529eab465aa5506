"""Cards: what a research run writes down about a thesis, built as nested documents, and snapshots over stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.documents import CARD, part

METRICS = ("rank_ic", "ic", "icir", "t_stat", "sharpe", "ann_return", "turnover", "mdd", "n_days", "n_obs", "sign", "residual_rank_ic", "net_sharpe_15bps")


def finite(c: Column) -> Column:
    """A number, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _struct(rows: DataFrame, name: str, keys: tuple[str, ...], defaults: dict[str, Column]) -> Column:
    """An object of columns that are called name_key, where the rows have them, else their defaults or null."""
    have = set(rows.columns)
    return F.struct(*((F.col(f"{name}_{k}") if f"{name}_{k}" in have else defaults.get(k, F.lit(None).cast("string"))).alias(k) for k in keys))


def build(rows: DataFrame) -> DataFrame:
    """card_id and value: a card as JSON per row. rows: run_id, generation, thesis_id, formula, verdict, sign, and whatever they have of columns named object_key (thesis_mechanism, audit_pbo, tier1_rank_ic, ...); all else is null, and so are numbers that aren't finite."""
    have = set(rows.columns)
    number = {c for c, kind in rows.dtypes if kind in ("double", "float")}
    rows = rows.withColumns({c: finite(F.col(c)) for c in number})
    tag = F.when(F.col("verdict") == "accept", "acc").otherwise("rej")
    card_id = F.concat_ws("_", F.lit("card"), "run_id", F.concat(F.lit("g"), "generation"), tag)
    metrics = {k: F.struct(*(F.col(f"{k}_{m}").alias(m) for m in METRICS if f"{k}_{m}" in have)) if any(f"{k}_{m}" in have for m in METRICS) else F.lit(None).cast("string") for k in ("tier1", "fresh_fold", "tier2")}
    audit = sorted(c for c in have if c.startswith("audit_"))
    fields = {
        "card_id": card_id, "thesis_id": F.col("thesis_id"), "generation": F.col("generation"), "thesis": _struct(rows, "thesis", CARD.nested["thesis"], {"horizon_days": F.lit(5)}),
        "pre_registered": F.struct(F.col("sign").alias("sign"), *(_struct(rows, "pre_registered", (k,), {"horizon_days": F.lit(5)})[k].alias(k) for k in CARD.nested["pre_registered"][1:])),
        "formula": F.col("formula"), "ast_canonical": F.col("formula"), "complexity": _struct(rows, "complexity", CARD.nested["complexity"], {}),
        "tier1_metrics": metrics["tier1"], "fresh_fold_metrics": metrics["fresh_fold"], "tier2_metrics": metrics["tier2"],
        "audit": F.struct(*(F.col(c).alias(c.removeprefix("audit_")) for c in audit)) if audit else F.lit(None).cast("string"),
        "redteam": _struct(rows, "redteam", ("verdict", "failed_tests"), {"verdict": F.lit("not_run")}), "verdict": F.col("verdict"), "lineage": _struct(rows, "lineage", CARD.nested["lineage"], {}),
        "provenance": _struct(rows, "provenance", CARD.nested["provenance"], {}),
    }
    return rows.select(card_id.alias("card_id"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"}).alias("value"))


def snapshot(docs: DataFrame) -> DataFrame:
    """One row over all documents that are JSON: n_cards, n_accepted, n_dsr, mean_dsr and max_dsr of the accepted, n_sign_checks, and the share of cards whose sign is the one they claimed."""
    d = docs.where("doc IS NOT NULL").select(
        part("doc", "verdict", "string").alias("verdict"), part("doc", "audit.deflated_sharpe", "double").alias("dsr"), F.signum(part("doc", "pre_registered.sign", "double")).alias("claimed"), F.signum(part("doc", "audit.realized_sign", "double")).alias("real")
    )
    accepted, known = F.coalesce(F.col("verdict") == "accept", F.lit(False)), F.col("claimed").isNotNull() & F.col("real").isNotNull()
    dsr = F.when(accepted, F.col("dsr"))
    return d.agg(F.count("*").alias("n_cards"), F.count_if(accepted).alias("n_accepted"), F.count(dsr).alias("n_dsr"), F.avg(dsr).alias("mean_dsr"), F.max(dsr).alias("max_dsr"), F.count_if(known).alias("n_sign_checks"), F.avg(F.when(known, (F.col("claimed") == F.col("real")).cast("double"))).alias("sign_agreement"))


def generations(docs: DataFrame) -> DataFrame:
    """generation (the number after _g in the thesis id, ? without one), n_cards, n_theses, n_accepted."""
    tag = F.regexp_extract(F.coalesce("thesis", F.lit("")), r"_g(\d+)", 1)
    d = docs.where("doc IS NOT NULL").select(part("doc", "thesis_id", "string").alias("thesis"), part("doc", "verdict", "string").alias("verdict"))
    return d.groupBy(F.when(tag == "", "?").otherwise(tag).alias("generation")).agg(F.count("*").alias("n_cards"), F.count_distinct("thesis").alias("n_theses"), F.count_if(F.col("verdict") == "accept").alias("n_accepted"))


def ledger_snapshot(trials: DataFrame, peeks: DataFrame) -> DataFrame:
    """One row: n_trials, n_theses, generation_tags (their numbers, in order, joined), n_holdout_peeks_used."""
    tag = F.regexp_extract(F.coalesce("thesis_id", F.lit("")), r"_g(\d+)", 1)
    tags = trials.select(F.when(tag == "", "?").otherwise(tag).alias("tag")).distinct().agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("generation_tags"))  # a row per generation
    return trials.agg(F.count("*").alias("n_trials"), F.count_distinct("thesis_id").alias("n_theses")).crossJoin(tags).crossJoin(peeks.agg(F.count("*").alias("n_holdout_peeks_used")))


def register() -> None:
    from ..sources import panel as source
    from ..sources.documents import checked
    from .queries import query, r

    def stored(spark, sf_dir):
        """doc_id and value: a card per document, from its label and its figures, some of them spoiled."""
        d = source.read(spark, sf_dir, "documents").join(source.read(spark, sf_dir, "labels"), "doc_id", "left")
        k = F.col("doc_id")
        rows = d.select(
            "doc_id", F.col("lang").alias("run_id"), (k % 7).alias("generation"), F.when(k % 10 == 9, F.lit("loose")).otherwise(F.concat(F.lit("th_"), "source", F.lit("_g"), k % 7)).alias("thesis_id"), F.lit("rank(close)").alias("formula"),
            F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject").when(k % 3 == 0, "revise").otherwise("maybe").alias("verdict"), F.when(k % 2 == 0, 1).otherwise(-1).alias("sign"),
            F.when(k % 5 == 0, None).when(k % 3 == 0, 1).otherwise(-1).alias("audit_realized_sign"), (F.col("n_chars") % 1000 / 1000.0).alias("audit_deflated_sharpe"), F.array(F.lit("close")).alias("provenance_fields_used"),
        )
        rows = rows.withColumn("audit_deflated_sharpe", F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("audit_deflated_sharpe")))
        numbered = rows.withColumn("run_id", F.concat_ws("-", "run_id", "doc_id"))
        out = build(numbered).select(F.regexp_extract("card_id", r"-(\d+)_", 1).cast("long").alias("doc_id"), "value")
        spoiled = F.when(k % 13 == 0, F.left("value", F.length("value") - 1)).when(k % 17 == 0, F.replace("value", F.lit('"formula"'), F.lit('"form"'))).when(k % 19 == 0, F.replace("value", F.lit('"edit_motif"'), F.lit('"motif"'))).when(k % 23 == 0, F.lit("[1, 2]"))
        return out.withColumn("value", F.coalesce(spoiled, F.col("value")))

    nested = ", ".join
    q = lambda keys: "{" + nested(f"'{k}': NULL" for k in keys) + "}"
    docs_sql = f"""
WITH c AS (SELECT doc_id, CAST(to_json({{'card_id': 'card_' || lang || '-' || doc_id || '_g' || doc_id % 7 || CASE WHEN quality = 1 THEN '_acc' ELSE '_rej' END,
  'thesis_id': CASE WHEN doc_id % 10 = 9 THEN 'loose' ELSE 'th_' || source || '_g' || doc_id % 7 END, 'generation': doc_id % 7, 'thesis': {q(CARD.nested['thesis'])}, 'formula': 'rank(close)', 'ast_canonical': 'rank(close)',
  'pre_registered': {{'sign': CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END, 'horizon_days': 5, 'committed_at': NULL, 'hash': NULL}}, 'complexity': {q(CARD.nested['complexity'])}, 'tier1_metrics': NULL, 'fresh_fold_metrics': NULL, 'tier2_metrics': NULL, 'redteam': {{'verdict': 'not_run'}},
  'audit': {{'realized_sign': CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END, 'deflated_sharpe': CASE WHEN doc_id % 11 <> 0 THEN n_chars % 1000 / 1000.0 END}},
  'verdict': CASE WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'reject' WHEN doc_id % 3 = 0 THEN 'revise' ELSE 'maybe' END, 'lineage': {q(CARD.nested['lineage'])}, 'provenance': {{'fields_used': ['close']}}}}) AS VARCHAR) AS v FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN left(v, length(v) - 1) WHEN doc_id % 17 = 0 THEN replace(v, '"formula"', '"form"') WHEN doc_id % 19 = 0 THEN replace(v, '"edit_motif"', '"motif"') WHEN doc_id % 23 = 0 THEN '[1, 2]' ELSE v END AS v FROM c),
j AS (SELECT doc_id, CASE WHEN json_valid(v) THEN v::JSON END AS d FROM s)"""
    missing = [("d IS NULL", "not json"), ("json_type(d) <> 'OBJECT'", "not an object"), *((f"NOT json_exists(d, '$.{k}')", f"no {k}") for k in CARD.top), ("coalesce(trim(d->>'$.card_id'), '') = ''", "blank card_id")]
    for sub, keys in CARD.nested.items():
        missing += [(f"coalesce(json_type(d, '$.{sub}'), '') <> 'OBJECT'", f"{sub} is no object"), *((f"NOT json_exists(d, '$.{sub}.{k}')", f"no {sub}.{k}") for k in keys)]
    missing += [("coalesce(d->>'$.verdict', '') NOT IN ('accept', 'reject', 'revise', 'provisional')", "other verdict"), ("coalesce(CAST(d->>'$.pre_registered.sign' AS INTEGER), 0) NOT IN (-1, 1)", "other pre_registered.sign")]

    @query("card_documents", f"{docs_sql} SELECT doc_id, CASE {' '.join(f'WHEN {test} THEN {chr(39)}{why}{chr(39)}' for test, why in missing)} END AS reason FROM j")
    def card_documents(spark, sf_dir):
        return checked(stored(spark, sf_dir), CARD).select("doc_id", "reason")

    @query("card_snapshots", f"{docs_sql}, x AS (SELECT d->>'$.verdict' AS verdict, CAST(d->>'$.audit.deflated_sharpe' AS DOUBLE) AS dsr, sign(CAST(d->>'$.pre_registered.sign' AS DOUBLE)) AS claimed, sign(CAST(d->>'$.audit.realized_sign' AS DOUBLE)) AS real FROM j WHERE d IS NOT NULL) SELECT count(*) AS n_cards, count(*) FILTER (verdict = 'accept') AS n_accepted, count(dsr) FILTER (verdict = 'accept') AS n_dsr, round(avg(dsr) FILTER (verdict = 'accept'), 6) AS mean_dsr, max(dsr) FILTER (verdict = 'accept') AS max_dsr, count(*) FILTER (claimed IS NOT NULL AND real IS NOT NULL) AS n_sign_checks, round(avg(CASE WHEN claimed = real THEN 1.0 WHEN claimed <> real THEN 0.0 END), 6) AS sign_agreement FROM x")
    def card_snapshots(spark, sf_dir):
        return snapshot(checked(stored(spark, sf_dir), CARD)).withColumns({"mean_dsr": r("mean_dsr"), "sign_agreement": r("sign_agreement")})

    @query("card_generations", f"{docs_sql}, x AS (SELECT d->>'$.thesis_id' AS thesis, d->>'$.verdict' AS verdict FROM j WHERE d IS NOT NULL) SELECT coalesce(nullif(regexp_extract(coalesce(thesis, ''), '_g(\\d+)', 1), ''), '?') AS generation, count(*) AS n_cards, count(DISTINCT thesis) AS n_theses, count(*) FILTER (verdict = 'accept') AS n_accepted FROM x GROUP BY 1")
    def card_generations(spark, sf_dir):
        return generations(checked(stored(spark, sf_dir), CARD))

    @query("ledger_snapshot", "WITH t AS (SELECT CASE WHEN event_type = 'error' THEN 'th_' || user_id ELSE 'th_' || user_id || '_g' || event_id % 12 END AS thesis_id FROM events WHERE event_type <> 'signup') SELECT count(*) AS n_trials, count(DISTINCT thesis_id) AS n_theses, (SELECT string_agg(tag, ',' ORDER BY tag) FROM (SELECT DISTINCT coalesce(nullif(regexp_extract(thesis_id, '_g(\\d+)', 1), ''), '?') AS tag FROM t)) AS generation_tags, (SELECT count(*) FROM events WHERE event_type = 'signup') AS n_holdout_peeks_used FROM t")
    def ledger_snapshot_(spark, sf_dir):
        e = source.read(spark, sf_dir, "events")
        thesis = F.concat_ws("", F.lit("th_"), "user_id", F.when(F.col("event_type") != "error", F.concat(F.lit("_g"), F.col("event_id") % 12)))
        return ledger_snapshot(e.where("event_type <> 'signup'").select(thesis.alias("thesis_id")), e.where("event_type = 'signup'"))
