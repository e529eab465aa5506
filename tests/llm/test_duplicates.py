import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from crossgrid.llm import near_dup, substring_dedup
from crossgrid.llm.common import components, whole_groups

from .fixtures import documents, lowered, table, words


def brute(rows, n, percent):
    """Size of each set, and the smallest id that each document reaches."""
    sets = {}
    for k, text, *_ in rows:
        w = lowered(text)
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [k for k in sets if k is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in sets}


def edited(seed, base, n, edits):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, set_bytes", [(1024, near_dup.SET_BYTES), (6, near_dup.SET_BYTES), (1024, 4000)])
def test_classes_are_those_of_all_pairs(spark, small, set_bytes):
    rows = documents()
    for g in range(4):
        rows += [(1000 + 100 * g + k, t, "en", "s", 1, 1, "", "", "") for k, t in enumerate(edited(g, words(50 + g, 90), 30, 7))]
    for n, percent in ((3, 85), (5, 80)):
        want = brute(rows, n, percent)
        got = near_dup.near_duplicates(table(spark, rows), n, percent, small=small, set_bytes=set_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == want[r.doc_id], r
                assert r.kept == (r.component_id == r.doc_id)
            else:
                assert r.kept


def test_groups_of_over_two_gib_keep_all_rows():
    """As gathered by tasks: binaries of one group have more bytes than offsets of 32 bits can name."""
    big = pa.array([bytes(1_200_000_000)], pa.binary())
    parts = [pa.record_batch([pa.array([k]), pa.array([r]), big], ["key", "rep", "data"]) for k, r in ((7, 1), (7, 2), (8, 3))]
    got = [(b.num_rows, at.tolist(), [len(b.column(2)[k].as_buffer()) for k in range(b.num_rows)]) for b, at in whole_groups(iter(parts))]
    assert got == [(2, [0, 2], [1_200_000_000] * 2), (1, [0, 1], [1_200_000_000])]


def test_dense_groups_end(spark):
    """Copies that agree nearly everywhere stay together down to the last level, where blocks meet the pivot block."""
    rows = [(k, t, "en", "s", 1, 1, "", "", "") for k, t in enumerate(edited(9, words(77, 400), 40, 1))]
    got = near_dup.near_duplicates(table(spark, rows), 3, 85, small=8, depth=2).collect()
    assert {r.component_id for r in got} == {0}


def test_pairs_apart_from_a_dense_group_meet(spark):
    """Pairs that are linked to nobody else, in nodes that hold nearly all documents and are compared in blocks."""
    r, rows = random.Random(5), []
    for k in range(80):
        w = words(78, 400)
        for _ in range(3):
            w[r.randrange(len(w))] = f"pair{k}x{r.randrange(10**6)}"
        v = list(w)
        v[r.randrange(len(v))] = f"one{k}"
        rows += [(i, " ".join(t), "en", "s", 1, 1, "", "", "") for i, t in ((k, w), (1000 + k, v))]
    want = brute(rows, 3, 95)
    assert len({c for _, c in want.values()}) == 80
    got = near_dup.near_duplicates(table(spark, rows), 3, 95, small=8, depth=0).collect()
    assert {x.doc_id: x.component_id for x in got} == {k: c for k, (_, c) in want.items()}


def test_linked_pairs_agree_enough():
    """By the binomial tail, pairs at the threshold fall short of the agreement with chance 1e-6 at most, and one more would be too much."""
    for percent in (50, 80, 85, 95):
        p, k = percent / 100, near_dup.least_agreement(percent)
        pmf = [math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(65)]
        assert sum(pmf[:k]) <= 1e-6 < sum(pmf[: k + 1])
    sketch = bytes([1] * 36 + [2] * 28), bytes([1] * 36 + [3] * 28)
    rows = pa.record_batch([pa.array([7, 7]), pa.array([1, 2]), pa.array([100, 100]), pa.array(sketch)], ["key", "rep", "size", "sketch"])
    assert [sum(b.num_rows for b in near_dup._clusters(x)([rows])) for x in (80, 85)] == [2, 0]


def test_near_edges(spark):
    assert near_dup.near_duplicates(table(spark, []), 3, 85).count() == 0
    kept = near_dup.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and {3, 4, 5, 6} <= set(ids) and 8 not in ids


def test_forest():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 30))
        pairs = r.integers(0, n, (int(r.integers(0, 40)), 2))
        low = near_dup.forest(n, pairs)
        label = np.arange(n)
        for _ in range(n):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        assert (low == label).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 100: 50, 50: 50, 70: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gear_looks_back_sixteen_bytes():
    r = np.random.default_rng(4)
    tail = r.integers(0, 256, 64).astype(np.uint8)
    ends = []
    for n in (0, 5, 40):
        data = np.concatenate([r.integers(0, 256, n).astype(np.uint8), tail])
        ends.append(substring_dedup.gear(data, np.array([0, len(data)]))[-49:])
        slow = 0
        for b in data[-16:]:
            slow = (2 * slow + int(substring_dedup._GEAR[b])) & 0xFFFF
        assert ends[-1][-1] == slow
    assert (ends[0] == ends[1]).all() and (ends[1] == ends[2]).all()


def repeats(texts, n):
    """By document the n-word runs that an earlier document, or the document before them, has."""
    seen, out = {}, collections.Counter()
    for k in sorted(texts):
        w = (texts[k] or "").split()
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), (k, i)) != (k, i):
                out[k] += 1
    return out


def test_repeated_passages_go_once(spark):
    rows = [x for x in documents() if x[0] is not None]
    for k in range(200, 240):
        passage = words(900 + k % 4, 60)
        rows.append((k, " ".join(words(k, 10 + k % 13) + passage + words(2 * k, 15)), "en", "s", 1, 1, "", "", ""))
    before = {x[0]: x[1] for x in rows}
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    after = {r.doc_id: r.text for r in got}
    assert len(repeats(before, 51)) > 30 and not repeats(after, 51)
    dirty = repeats(before, substring_dedup.LEAST)
    for r in got:
        if r.doc_id not in dirty:
            assert r.text == before[r.doc_id] and r._n_runs == 0
        elif r._n_runs and r.doc_id >= 200:
            assert r._first_ids and min(r._first_ids) < r.doc_id
    assert after[200] == before[200] and after[3] is None and after[4] == ""
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def plain_removal(rows):
    """The removal in plain Python over whole documents: units by document, first documents by digest, unions of repeated units of SPAN words or more."""
    import pyarrow as pa

    firsts, units = {}, {}
    for k, text in sorted(rows.items()):
        u = substring_dedup.Units(pa.array([text], pa.string()))
        units[k] = list(zip(u.start.tolist(), u.end.tolist(), u.digest.tolist()))
        for _, _, d in units[k]:
            firsts[d] = min(firsts.get(d, k), k)
    out = {}
    for k, us in units.items():
        seen, gone = set(), []
        for a, b, d in us:
            if firsts[d] < k or d in seen:
                gone.append((a, b, d))
            seen.add(d)
        marked = set()
        for a, b, _ in gone:
            marked |= set(range(a, b))
        runs, at = [], None
        for i in sorted(marked):
            if at is None or i != at + 1:
                runs.append([i, i + 1])
            runs[-1][1], at = i + 1, i
        # units that touch make one run, as ranges that only meet do
        runs = [r for r in runs if r[1] - r[0] >= substring_dedup.SPAN]
        inside = {d for a, b, d in gone if any(x <= a and b <= y for x, y in runs)}
        out[k] = (sum(b - a for a, b in runs), len(runs)), inside
    return out, {k: {d for _, _, d in us} for k, us in units.items()}


def test_removal_is_that_of_plain_python(spark):
    rows = {}
    for k in range(60):
        passages = [words(700 + j, 40) for j in ((k * 7) % 5, (k * 3) % 4)]
        rows[k] = " ".join(words(k, 12 + k % 9) + passages[0] + words(3 * k + 1, 8 + k % 20) + passages[1] * (1 + k % 2) + words(5 * k, 15))
    rows[60], rows[61] = None, " "
    data = [(k, t, "en", "s", 1, 1, "", "", "") for k, t in rows.items()]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, data).repartition(7)).collect()}
    want, units = plain_removal({k: t or "" for k, t in rows.items()})
    assert {k: (r._n_removed, r._n_runs) for k, r in got.items()} == {k: x for k, (x, _) in want.items()}
    assert sum(x[0] for x, _ in want.values()) > 1000
    for k, (_, inside) in want.items():
        firsts = got[k]._first_ids
        assert bool(firsts) == bool(inside) and all(f <= k and units[f] & inside for f in firsts)
        assert inside <= set().union(*(units[f] for f in firsts))


def test_columns_of_its_own_names_are_no_matter(spark):
    docs = table(spark).withColumnsRenamed({"kept": "_n_words", "ids": "_gone", "lang": "_order"})
    out = substring_dedup.substring_dedup(docs, report=False)
    assert out.columns == docs.columns and {r[0] for r in out.select("_n_words").collect()} == {"x"}
    twice = substring_dedup.substring_dedup(substring_dedup.substring_dedup(docs))
    assert twice.columns.count("_n_words") == 1 and twice.count() == docs.count()


def test_units_move_with_their_content():
    text = " ".join(words(6, 300))
    a = substring_dedup.Units(pa.array([text]))
    b = substring_dedup.Units(pa.array(["inserted words " + text]))
    shared = set(a.digest.tolist()) & set(b.digest.tolist())
    assert len(shared) >= len(a.digest) - 8
