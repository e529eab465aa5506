"""The prefix trie against plain Python over whole sequences."""

import hashlib
import random
import zlib

import pytest
from crossgrid.llm import prefix_trie as trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, k1 string"


def brute(rows, rebuilt=True):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, convs in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(full[c]) == len(path)).encode()).hexdigest())
        for path, convs in nodes.items()
    )


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0], r[1]))


def compare(spark, rows, monkeypatch=None):
    assert got(trie.trie_report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def world(seed, n):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 101, 250, 251, 399]:
        for t in range(r.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hi", "été 日本", "", "a longer text"]), 0, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    compare(spark, world(seed, 40))


def test_awkward_rows(spark):
    rows = world(3, 8)
    rows += [(None, 0, "user", "lost", 0, "x"), (60, None, "user", "first", 0, None), (60, 0, None, None, 0, None), (61, 5, "user", "x" * 50_000, 0, "x"), rows[0], rows[0]]
    rows += [(c, 0, "user", "hi", 0, "x") for c in range(500, 540)]  # short ones of a family of their own
    rows += [(c, 0, "user", "alone", 0, "x") for c in range(701, 715)]  # without the one that begins the family: some have no turns
    compare(spark, rows)
    assert got(trie.trie_report(spark.createDataFrame([], SCHEMA))) == []


def test_long_conversation_over_several_ranges(spark, monkeypatch):
    """A conversation of most rows is dealt to many tasks, and its digests still meet those of others."""
    monkeypatch.setattr(trie, "tasks", lambda *_: 9)
    rows = [(200, t, "user", f"turn {t % 7}", 0, "x") for t in range(700)] + [(c, t, "user", f"turn {t % 7}", 0, "x") for c in (201, 202, 203) for t in range(40 * (c - 200))]
    rows += [(c, t, "assistant", "same", 0, "x") for c in range(60) for t in range(3)]
    compare(spark, rows)
    same = spark.createDataFrame(rows, SCHEMA)
    assert same.repartitionByRange(9, "conv_id", "turn").where("conv_id = 200").select(F.spark_partition_id()).distinct().count() > 1


def test_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 100)
    compare(spark, [(c, 0, "user", "hi", 0, "x") for c in range(300)])


def test_not_rebuilt(spark):
    rows = world(4, 20)
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA))) == sorted(brute(rows, False), key=lambda r: (r[0], r[1]))


def test_subtree_sums_of_a_chain(spark):
    n = 100
    nodes = spark.createDataFrame([(k, 0, k - 1 if k else None, 0 if k else None, k, k) for k in range(n)], "k1 long, k2 long, p1 long, p2 long, depth long, v long")
    assert {r.k1: r.v for r in trie.roll_up(nodes, ["v"]).collect()} == {k: sum(range(k, n)) for k in range(n)}
