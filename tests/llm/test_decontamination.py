"""Decontamination against a word-by-word search, and its index against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from crossgrid.llm import decontamination as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words long, _spans string, c0 string"


def plain(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """Every window at every place."""
    wanted = {}
    for item, text in items:
        w = plain(text)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            wanted.setdefault(tuple(w[p : p + k]), set()).add("" if item is None else str(item))
    sizes, out = {len(k) for k in wanted}, []
    for doc, text, *_ in docs:
        w, hit, found = plain(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in wanted:
                    hit |= set(range(p, p + k))
                    found |= wanted[tuple(w[p : p + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def world(seed, n_docs, n_items, vocabulary):
    r = random.Random(seed)
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(r.choice([1, 4, 10, 17, 40]))) if k % 5 else " ".join(some(30))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        w = some(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            source = plain(r.choice(items)[1])
            a = r.randint(0, len(source) - 1)
            w[len(w) // 2 : len(w) // 2] = source[a : a + r.randint(1, 25)]
        docs.append((k, r.choice([" ", ", ", "\n", " -- "]).join(x.upper() if r.random() < 0.2 else x for x in w), -1, "x", "y"))
    return docs, items


VOCABULARY = [*"a b c d e f g h i j k l m n o p".split(), "été", "日本語", "x9", "ÀÉ"]
AWKWARD = [(None, None, 1, "x", "y"), (None, "", 1, "x", "y"), (7, " ,;. ", 1, "x", "y"), (7, "a", 1, "x", "y"), (8, "a b c d e f g h i j " * 300, 1, "x", "y"), (8, "A B-C d", 1, None, None)]


@pytest.mark.parametrize("block", [dec.BLOCK, 40])
def test_equals_brute_force(spark, block):
    docs, items = world(5, 120, 25, VOCABULARY)
    docs += AWKWARD + docs[:3]
    items += [(None, "n o p n o p n o p n o p"), (3, "日本語 a"), (99, None), (98, " ... "), (97, items[0][1]), (96, "a b c d e f g h i j")]
    given, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = dec.find_contamination(given, bench, block=block)
    assert found.columns == ["doc_id", "text", "n_words", "c0", *dec.ADDED]
    got = [(r.doc_id, r._n_words, r._n_hit, len(r._items), hashlib.sha256(",".join(r._items).encode()).hexdigest(), r._n_hit > 0) for r in found.collect()]
    assert sorted(got, key=str) == brute(docs, items)
    assert sum(g[2] for g in got) > 500


def test_report_on_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((tuple(r) for r in dec.contamination_report(docs, items).collect()), key=str)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got == want and any(r[5] for r in want)


def test_spans_are_cut_out(spark):
    text = "Keep this. ONE two-three four; five six seven eight nine ten eleven! And keep that été."
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text, 1, "x", "y"), (2, "all clean", 1, "x", "y"), (3, None, 1, "x", "y"), (4, "so: one two three four five six seven eight nine ten", 1, "x", "y")], DOCS)
    got = {r.doc_id: r for r in dec.decontaminate(docs, bench).collect()}
    assert got[1].text == "Keep this. And keep that été." and [(s.first, s.last) for s in got[1]._spans] == [(2, 12)]
    assert got[2].text == "all clean" and got[3].text is None and got[4].text == "so: " and got[1].c0 == "y"


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some, item = spark.createDataFrame([(1, "a b", 1, "x", "y")], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dec.contamination_report(docs, item).collect() == []
    assert [tuple(r)[:4] for r in dec.contamination_report(some, bench).collect()] == [(1, 2, 0, 0)]
    assert [tuple(r)[:4] for r in dec.contamination_report(some, item).collect()] == [(1, 2, 2, 1)]


def test_index_finds_all_places():
    r = np.random.default_rng(0)
    for _ in range(60):
        runs = [r.integers(1, r.integers(2, 5), r.integers(1, 40)) for _ in range(r.integers(1, 8))]
        text = np.concatenate([[*x, 0] for x in runs]).astype(np.uint32)
        index = dec.FMIndex(text, int(r.integers(1, 9)))
        patterns = sorted({tuple(int(v) for v in r.integers(1, 6, r.integers(1, 7))) for _ in range(12)})
        rows = np.zeros((len(patterns), 7), np.uint32)
        for k, p in enumerate(patterns):
            rows[k, 7 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p) for p in patterns]))
        for k, p in enumerate(patterns):
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]


def test_suffixes_of_many_copies():
    text = np.concatenate([[*range(1, 200), 0] for _ in range(50)]).astype(np.uint32)
    run = np.repeat(np.flatnonzero(text == 0), 200)
    order = dec.suffixes(text, run)
    keys = [(*text[s : run[s]].tolist(), 0, int(run[s])) for s in order[:3000].tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(text)))


def test_words_of_any_bytes():
    texts = ["a" * 3_000_000 + " b", None, "\x00\x7f{a}", "İ日", "A1_b2"]
    w = dec.words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(plain(t)) for t in texts]
