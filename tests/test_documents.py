"""Cards as nested documents: built, written, read back whole, checked, and counted."""

import json

import pytest
from crossgrid.plans import cards
from crossgrid.sources import documents


def card(**changes):
    base = {k: {} for k in documents.CARD.top} | {sub: dict.fromkeys(keys) for sub, keys in documents.CARD.nested.items()}
    base |= {"card_id": "c", "thesis_id": "th_x_g3", "verdict": "accept", "audit": {"deflated_sharpe": 0.97, "realized_sign": -1}}
    base["pre_registered"] |= {"sign": -1}
    for path, value in changes.items():
        at, *rest = path.split("__")
        if rest:
            base[at] = dict(base[at], **{rest[0]: value}) if value != "drop" else {k: v for k, v in base[at].items() if k != rest[0]}
        elif value == "drop":
            del base[at]
        else:
            base[at] = value
    return json.dumps(base)


CASES = [
    (card(), None), (card(tier1_metrics=None), None), (card(pre_registered__sign=1), None), (card(pre_registered__sign="-1"), None), ("{", "not json"), ("", "not json"), ("[1]", "not an object"), ("null", "not an object"),
    (card(formula="drop"), "no formula"), (card(card_id=" "), "blank card_id"), (card(thesis=[1]), "thesis is no object"), (card(lineage=None), "lineage is no object"), (card(lineage__edit_motif="drop"), "no lineage.edit_motif"),
    (card(provenance__fields_used="drop"), "no provenance.fields_used"), (card(verdict="survives"), "other verdict"), (card(verdict=None), "other verdict"), (card(pre_registered__sign=0), "other pre_registered.sign"), (card(pre_registered__sign="up"), "other pre_registered.sign"),
]


def test_reasons_and_nothing_lost(spark, tmp_path):
    for k, (text, _) in enumerate(CASES):
        (tmp_path / f"{k:02}.json").write_text(text)
    docs = documents.checked(documents.read_files(spark, str(tmp_path)), documents.CARD)
    got = {r.path[-7:-5]: r.reason for r in docs.collect()}
    assert len(got) == len(CASES) - 1  # an empty file has no row of text
    assert all(got[f"{k:02}"] == reason for k, (text, reason) in enumerate(CASES) if text)
    good, bad = documents.split(docs)
    assert good.columns == ["path", "doc"] and bad.columns == ["path", "value", "reason"] and good.count() + bad.count() == docs.count()
    lengths = {r.path[-7:-5]: len(r.value) for r in bad.collect()}
    assert lengths["04"] == 1 and lengths["06"] == 3
    rows = spark.createDataFrame([(t,) for t, _ in CASES], "value string")
    assert sorted(str(r.reason) for r in documents.checked(rows, documents.CARD).collect()) == sorted(str(x) for _, x in CASES)


def test_builder_round_trip(spark):
    rows = spark.createDataFrame(
        [("r1", 2, "th_r1_g2", "rank(close)", "accept", -1, "slow news", 0.03, float("nan"), float("inf"), 0.99, ["close"]), ("r2", 0, None, "f", "reject", 1, None, None, 1.0, 2.0, None, [])],
        "run_id string, generation int, thesis_id string, formula string, verdict string, sign int, thesis_mechanism string, tier1_rank_ic double, tier1_icir double, tier1_sharpe double, audit_deflated_sharpe double, provenance_fields_used array<string>",
    )
    built = cards.build(rows)
    found = {r.card_id: json.loads(r.value) for r in built.collect()}
    assert set(found) == {"card_r1_g2_acc", "card_r2_g0_rej"}
    one = found["card_r1_g2_acc"]
    assert set(documents.CARD.top) == set(one) and one["tier1_metrics"] == {"rank_ic": 0.03, "icir": None, "sharpe": None} and one["thesis"]["mechanism"] == "slow news" and one["thesis"]["horizon_days"] == 5
    assert one["provenance"]["fields_used"] == ["close"] and one["fresh_fold_metrics"] is None and one["redteam"]["verdict"] == "not_run"
    assert documents.checked(built, documents.CARD).where("reason IS NOT NULL").count() == 0


def test_snapshots_count_what_parses(spark):
    texts = [card(), card(audit__deflated_sharpe=None), card(audit__realized_sign=1), card(audit__realized_sign=None), card(verdict="odd", thesis_id="loose"), "{", card(audit=None, thesis_id=None)]
    docs = documents.checked(spark.createDataFrame([(t,) for t in texts], "value string"), documents.CARD)
    s = cards.snapshot(docs).first()
    assert (s.n_cards, s.n_accepted, s.n_dsr, s.mean_dsr, s.max_dsr, s.n_sign_checks) == (6, 5, 3, pytest.approx(0.97), 0.97, 4) and s.sign_agreement == 0.75
    assert {r.generation: (r.n_cards, r.n_theses) for r in cards.generations(docs).collect()} == {"3": (4, 1), "?": (2, 1)}
    empty = docs.where("false")
    assert cards.snapshot(empty).first().n_cards == 0 and cards.generations(empty).count() == 0


def test_schema_over_documents(spark):
    docs = documents.checked(spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5}',)], "value string"), documents.Shape())
    found = documents.common_schema(docs).first()
    assert found.n == 2 and "a: DECIMAL(" in found.schema and "b: OBJECT<c: STRING>" in found.schema


def test_ledger_snapshot(spark):
    trials = spark.createDataFrame([("th_a_g1",), ("th_a_g1",), ("th_b_g12",), ("plain",), (None,)], "thesis_id string")
    got = cards.ledger_snapshot(trials, spark.createDataFrame([(1,)], "peek_id int")).first()
    assert tuple(got) == (5, 3, "1,12,?", 1)
