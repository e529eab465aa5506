import csv
import datetime as dt
import itertools
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from crossgrid.plans import gates, loopstate, research, stores
from crossgrid.sources import files, synthetic

D = dt.date


def test_false_discoveries_look_at_the_last_accepted(spark):
    rng = random.Random(1)
    rows = [("r", k, rng.choice(["accept", "reject", None]), rng.choice([True, False, None])) for k in range(40)]
    got = {r.seq: r.fdr for r in loopstate.accepted_fdr(spark.createDataFrame(rows, "run string, seq int, verdict string, holdout_failed boolean")).collect()}
    for k in range(40):
        last = [bool(f) for _, i, v, f in rows if i <= k and v == "accept"][-6:]
        assert got[k] == pytest.approx(sum(last) / len(last) if last else 0.0)


def test_families_take_turns(spark):
    pulls = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0)], "family string, reward double")
    gens = spark.range(4).select(F.col("id").alias("generation"))

    def order(names):
        fams = spark.createDataFrame([(n,) for n in names], "family string")
        return [r.family for r in loopstate.suggest(loopstate.shares(fams, pulls), gens).orderBy("generation").collect()]

    assert order("abc") == ["a", "b", "a", "b"]
    assert order("abcxy") == ["x", "y", "x", "y"]
    many = loopstate.shares(spark.range(25).select(F.col("id").cast("string").alias("family")), pulls).collect()
    assert {r.share for r in many} == {1 / 25}


def test_overrides_and_priors(spark):
    seen = [("a", k, 0.0, True) for k in range(4)] + [("b", k, 1.0, True) for k in range(4)] + [("c", 0, 1.0, True)]
    state = stores.lessons(spark.createDataFrame(seen, "motif string, seq int, helped double, confident boolean"))
    hand = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("z", 1, True), ("y", 1, False)], "motif string, seq int, force boolean")
    out = loopstate.with_overrides(state, hand)
    assert {r.motif: r.veto for r in out.collect()} == {"a": False, "b": False, "c": False, "z": True}
    assert [r.motif for r in loopstate.priors(out).collect()] == ["b", "a"]
    assert [r.motif for r in loopstate.priors(out, F.col("motif"), ("A",)).collect()] == ["a"]


def test_lineage_of_two_tables_and_cycles(spark):
    cards = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "card_id long, parent_id long")
    up = stores.lineage(cards, 5)
    other = stores.lineage(cards.where("card_id = 1"))
    assert {(r.ancestor, r.steps) for r in up.where("card_id = 3").collect()} == {(3, 0), (2, 1), (1, 2)}
    assert up.where("card_id = 8").agg(F.max("steps")).first()[0] == 5
    assert other.count() == 1
    assert {(r.card_id, r.child) for r in loopstate.children(cards).collect()} == {(1, 2), (2, 3), (9, 8), (8, 9)}


def test_retrieval_falls_back_to_the_pool(spark):
    pool = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, text string")
    assert [r.id for r in loopstate.retrieve(pool, F.col("text"), ["Y"], "id", 2).collect()] == [2]
    assert [r.id for r in loopstate.retrieve(pool.where("id < 3"), F.col("text"), ["q"], "id", 1).collect()] == [1]


def test_blocks_are_purged(spark):
    rng = random.Random(3)
    T, M, purge = 50, 4, 2
    r = [[rng.gauss(0, 1) for _ in range(M)] for _ in range(T)]
    q = T // 8
    blocks = [r[b * q : (b + 1) * q][purge:] for b in range(8)]

    def sr(rows, m):
        x = [row[m] for row in rows]
        mu = sum(x) / len(x)
        return mu / math.sqrt(sum((v - mu) ** 2 for v in x) / (len(x) - 1))

    bad = n = 0
    for inside in itertools.combinations(range(8), 4):
        a = [row for b in inside for row in blocks[b]]
        z = [row for b in range(8) if b not in inside for row in blocks[b]]
        best = max(range(M), key=lambda m: sr(a, m))
        rank = 1 + sum(sr(z, m) < sr(z, best) for m in range(M))
        bad += rank / (M + 1) < 0.5
        n += 1
    rows = spark.createDataFrame([(t, f"s{m}", r[t][m]) for t in range(T) for m in range(M)], "t long, strategy string, r double")
    got = gates.pbo(rows, 8, purge).first()
    assert got.n_splits == n and got.pbo == pytest.approx(bad / n)


def test_surrogates_are_permutations_and_a_real_signal_beats_them(spark):
    w = synthetic.world(spark, 160, 30, edge=0.5).withColumn("junk", synthetic.normal(99, "symbol", "pos"))
    maps = loopstate.surrogate_maps(w, 3).collect()
    assert all(len({m.target for m in maps if m.k == k}) == 30 for k in range(4)) and len(maps) == 120
    assert all(m.symbol == m.target and m.flip == 1.0 for m in maps if m.k == 0)
    assert loopstate.surrogate_pbo(w, "latent", "fwd_ret_1_demeaned").first().pbo < 0.05


def test_worlds_have_their_properties(spark):
    w = synthetic.world(spark, 300, 20)
    late = w.select("symbol", (F.col("pos") + 1).alias("pos"), F.col("latent").alias("before"))
    a = w.join(late, ["symbol", "pos"]).agg(F.corr("latent", "before").alias("rho"), F.stddev("latent").alias("sd")).first()
    assert abs(a.rho - 0.92) < 0.03 and abs(a.sd - 1) < 0.25
    m = synthetic.membership(spark, 63, 30, 10)
    assert m.groupBy("pos").count().select("count").distinct().collect()[0][0] == 10 and m.select("symbol").distinct().count() > 10
    assert synthetic.symbols(spark, 7).select("isin").distinct().count() == 7
    assert synthetic.features(spark, 5, 4).where("mom IS NULL OR vol <= 0").count() == 0


def test_metadata_lists(spark, tmp_path):
    with open(tmp_path / "sectors.csv", "w", newline="") as f:
        csv.writer(f).writerows([["Symbol ", " Industry", "ISIN Code"], [" abc ", "Metal ", " IN1"], ["M&M", "Cars", "IN2"]])
    assert {tuple(r) for r in files.read_sectors(spark, str(tmp_path / "sectors.csv")).collect()} == {("ABC", "IN1", "Metal"), ("M&M", "IN2", "Cars")}
    with open(tmp_path / "lists.csv", "w", newline="") as f:
        csv.writer(f).writerows([["date", "symbols"], ["2020", "a, m & m,,B "], ["2021", "b,C"], ["2022", None]])
    assert {r.symbol for r in files.read_index_members(spark, str(tmp_path / "lists.csv")).collect()} == {"A", "M&M", "B", "C"}
    rows = spark.createDataFrame([(" eq",), ("BE",), ("GB",), (None,)], "series string")
    assert files.of_series(rows).count() == 1 and files.of_series(rows, "EQ", "BE").count() == 2


def test_states_of_a_report(spark, tmp_path):
    path = str(tmp_path / "report")
    assert files.cache_state(spark, path, {}) == "not_built" and not files.has_rows(spark, path)
    files.write_cache(spark.range(3), path, {"id": "bigint"}, ["src"])
    assert files.has_rows(spark, path)
    assert files.cache_state(spark, path, {"src": time.time() - 3600}) == "ok"
    assert files.cache_state(spark, path, {"src": time.time() + 3600}) == "stale"
    spark.range(1).selectExpr("id AS other").write.mode("overwrite").parquet(path)
    assert files.cache_state(spark, path, {}) == "broken"
    empty = str(tmp_path / "empty")
    files.write_cache(spark.range(0), empty, {"id": "bigint"}, [])
    assert files.cache_state(spark, empty, {}) == "no_source" and not files.has_rows(spark, empty)
    assert os.path.isdir(empty)


def test_each_gate_catches_its_kind(spark):
    pool = research.world_pool(synthetic.world(spark, 150, 24, edge=0.4), 2, 10)
    got = research.world_ablation(pool).orderBy("place").collect()
    assert [r.signal_id for r in got] == [f"{k}_{i}" for i in range(2) for k in research.KINDS]
    for r in got:
        if r.kind == "genuine":
            assert r.novelty and r.statistics and r.redteam
        elif r.kind == "leaky":
            assert r.statistics and r.ic > 0.9 and not r.redteam
        else:
            assert not r.redteam and (r.kind == "overfit" or not r.statistics)
    mean = {r.signal_id: r.ic for r in got}
    assert mean["overfit_0"] > 0.02
