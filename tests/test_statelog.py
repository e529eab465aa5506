"""Atomic commits: one of many writers wins, readers see whole commits, an audit sees what was touched."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from crossgrid.plans import ledger
from crossgrid.sources.statelog import ConflictError, StateLog


def rows(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x long")


def test_versions_and_unseen_files(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), "x long")
    assert log.version() == 0 and log.read().count() == 0 and log.audit().count() == 0
    assert log.append(rows(spark, 1, 2)) == 1 and log.append(rows(spark, 3)) == 2
    rows(spark, 99).write.parquet(str(tmp_path / "log/data/of-a-lost-writer"))
    assert sorted(r.x for r in log.read().collect()) == [1, 2, 3] and sorted(r.x for r in log.read(1).collect()) == [1, 2]
    assert log.transact(lambda old: None) is None and log.version() == 2
    assert not log.files.put_if_absent(log._manifest(2), "{}") and json.loads(log.files.text(log._manifest(2)))["rows"] == 1
    assert [tuple(r) for r in log.audit().orderBy("version").collect()] == [(1, 2, True, None), (2, 1, True, None)]


def test_losing_writer_decides_anew(spark, tmp_path):
    log, seen = StateLog(spark, str(tmp_path / "log"), "x long"), []

    def make(old):
        seen.append(old.count())
        if len(seen) == 1:
            log.append(rows(spark, 7))  # another writer, between the look and the commit
        return rows(spark, 100 + seen[-1])

    assert log.transact(make) == 2 and seen == [0, 1]
    assert sorted(r.x for r in log.read().collect()) == [7, 101]
    assert len(list((tmp_path / "log/data").iterdir())) == 2  # the first try's files are gone

    def always(old):
        log.append(rows(spark, 8))
        return rows(spark, 0)

    with pytest.raises(ConflictError):
        log.transact(always, tries=2)


def test_last_peek_goes_to_one_of_eight(spark, tmp_path):
    budget = ledger.PeekBudget(spark, str(tmp_path / "peeks"), most=3)
    assert [budget.reserve("a"), budget.reserve("b")] == [1, 2]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: ledger.PeekBudget(spark, str(tmp_path / "peeks"), most=3).reserve(f"c{k}"), range(8)))
    assert sorted(g for g in got if g) == [3] and budget.used() == 3 and budget.reserve("d") is None
    budget.finish(3, "c", {"rank_ic": 0.5})
    found = {r.peek_id: r for r in budget.records().collect()}
    assert len(found) == 3 and found[3].status == "used" and json.loads(found[3].result) == {"rank_ic": 0.5} and found[1].status == "reserved"
    assert budget.used() == 3


def test_all_of_many_writers_get_in(spark, tmp_path):
    trials = ledger.Trials(spark, str(tmp_path / "trials"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: trials.record(f"t{k % 2}", f"rank(delta(close, {k + 1}))", "val_a", 0.01 * k, float(k), 100), range(6)))
    found = trials.log.read().collect()
    assert sorted(r.trial_id for r in found) == [1, 2, 3, 4, 5, 6]
    assert trials.log.audit().where("NOT sound").count() == 0


def test_pressure_counts_shapes(spark, tmp_path):
    trials = ledger.Trials(spark, str(tmp_path / "trials"))
    empty = trials.pressure("a", "rank(close)")
    assert (empty["trials"], empty["effective"], empty["variance"]) == (0, 1.0, None)
    for thesis, formula, t, counts in (("a", "rank(delta(close, 5))", 2.0, True), ("a", "rank(delta(close, 9))", 4.0, True), ("b", "rank(volume)", 1.0, True), ("b", "rank(open)", 9.0, False)):
        trials.record(thesis, formula, "val_a", 0.1, t, 100, counts)
    p = trials.pressure("a", "rank(delta(close, 21))")
    assert (p["trials"], p["own_trials"], p["effective_all"], p["effective_own"], p["effective"]) == (3, 2, 2.0, 1.0, 2.0)
    assert abs(p["variance"] - 0.0233333333) < 1e-9
    assert trials.pressure("c", "rank(high)")["effective_all"] == 3.0


def test_audit_sees_what_was_touched(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), "x long")
    for k in range(4):
        log.append(rows(spark, k))
    first = Path(log._manifest(2))
    first.write_text(first.read_text().replace('"rows": 1', '"rows": 2'))
    part = next((tmp_path / "log" / json.loads(Path(log._manifest(4)).read_text())["files"][0][0]).parent.glob("*.parquet"))
    part.unlink()
    got = {r.version: (r.sound, r.reason) for r in log.audit().collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "an earlier commit was changed"), 4: (False, "1 files changed or gone")}
    Path(log._manifest(1)).unlink()
    assert log.audit().where("version = 1").first().reason == "no manifest"
