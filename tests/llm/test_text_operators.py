import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossgrid.llm import bpe, encoder, importance, lattice_lm, packing, quality_rules
from crossgrid.llm.words import Words

from .fixtures import PIECES, TOKENIZER, documents, lowered, table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_runs_between_six_bytes(texts):
    w = Words(pa.array(texts, pa.string()))
    got = [[w.text(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [t.encode().split() for t in texts]
    seen = {}
    for i in range(len(w.start)):
        assert seen.setdefault(w.text(i), w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_bpe_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    lib, own = tokenizers.Tokenizer.from_file(TOKENIZER) if not hasattr(test_bpe_is_the_library, "lib") else test_bpe_is_the_library.lib, bpe.opened(TOKENIZER)
    test_bpe_is_the_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_digests(spark, library):
    got = {r.doc_id: r for r in bpe.bpe_digests(table(spark), TOKENIZER).collect()}
    for row in documents():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        r = got[row[0]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(table(spark, []), TOKENIZER).count() == 0


def test_bpe_columns(spark):
    rows = bpe.bpe_encode(table(spark, documents()[:9]).drop("ids"), TOKENIZER)
    back = bpe.bpe_decode(rows.withColumn("text", F.lit("clash")), TOKENIZER, out="decoded").select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in back}[7] == "one</w> two</w>"


def brute_counts(text):
    text = text or ""
    w = text.encode().split()
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_edges(spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20, 50)] + [(13, 0, 0), (14, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_report(table(spark), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(documents())
    for row in documents():
        r, want = by[row[0]], brute_counts(row[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, row[0]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert all(by[k].kept for k in range(20, 50))
    kept = quality_rules.quality_filter(table(spark), labels)
    assert kept.columns == table(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality_rules.quality_report(table(spark, []), labels).count() == 0
    assert quality_rules.quality_report(table(spark), labels.limit(0)).where("kept").count() == sum(not r.base_failed for r in got)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (300, 0.01), (1000, 0.2)):
        for k in (0, 1, 3, n // 10, n // 3, n - 1, n):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_cutoffs_keep_their_promise():
    """Over many draws, a certified cutoff rejects more good texts than allowed at most as often as the error says."""
    r, broken, grid, risk, error = random.Random(5), 0, tuple(x / 20 for x in range(20, 0, -1)), 0.05, 0.1
    for _ in range(200):
        bins = collections.defaultdict(lambda: [0, 0])
        for _ in range(400):
            bins[sum(r.random() > c for c in grid)][0] += 1
        for _ in range(200):
            bins[len(grid)][1] += 1
        # a good text's value is uniform, and each of its grid comparisons is drawn again: any monotone law would do
        good = {e: tuple(v) for e, v in bins.items()}
        found = quality_rules.choose(good, grid, risk, error, 0.0)
        if found is not None:
            true = sum(v[0] for e, v in bins.items() if e >= len(grid) - grid.index(found)) / 400
            broken += true > 2 * risk
    assert broken <= 200 * error


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces(PIECES)
    log = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces.names))))
    pieces.scored(log)

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            p = pieces.log.get(text[:n])
            if p is None and n == 1:
                p = sum(pieces.log_byte[b] for b in text[0].encode())
            if p is not None:
                total += math.exp(p) * brute(text[n:])
        return total

    for word in ("a", "the", "other", "straße", "日本", "qzx", "inging"):
        assert pieces.word(word) == pytest.approx(math.log(brute("▁" + word)), rel=1e-9)


def test_lm_scores(spark):
    rows = documents()
    got = lattice_lm.lm_scores(table(spark), PIECES).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    c = collections.Counter()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    for k, text, *_ in rows:
        if not held(k):
            c.update([*lowered(text), None])
    n, v = sum(c.values()), len(c)
    for k, text, *_ in rows:
        w = [*lowered(text), None]
        r = by[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-6)
        assert r.score < 0
    assert lattice_lm.lm_scores(table(spark, []), PIECES).count() == 0


def test_importance(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = importance.importance_report(docs, labels).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.toxic]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    edge = importance.importance_report(table(spark), labels.limit(0)).collect()
    assert len(edge) == len(documents()) and all(r.kept and r.log_weight == 0 for r in edge)
    assert importance.importance_report(table(spark, []), labels).count() == 0
    some = importance.importance_report(docs, labels, share=0.5)
    assert some.where("kept").count() == math.ceil(docs.count() / 2)
    both = importance.importance_report(docs, labels, sampled=0.25)
    assert both.where("sampled").count() == math.ceil(docs.count() / 4) and both.where("sampled AND NOT kept").count() == 0
    other = importance.importance_filter(docs.withColumnRenamed("doc_id", "k").withColumnRenamed("text", "t"), labels, share=0.5, id_col="k", text_col="t")
    assert {r.k for r in other.collect()} == {r.doc_id for r in some.where("kept").collect()}
    kept = importance.importance_filter(docs, labels, share=0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in some.where("kept").collect()}


def test_importance_is_that_of_counters(spark):
    """Log weights, noise and the kept set against plain counters over hashed n-grams, with nulls, empty texts, ties and repeated rows."""
    rows = [(k, t, *rest) for k, t, *rest in documents() if k is not None and k != 11]
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(20, 60)] + [(3, 1, 0), (None, 1, 0), (21, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.importance_report(table(spark, rows), labels, share=0.4).collect()
    buckets = {}
    for k, text, *_ in rows:
        one = [int(x) for x in Words(pa.array([text], pa.string()), lower=True).hash]
        two = [int(importance.grams(np.array([a, b], np.uint64), 2)[0]) for a, b in zip(one, one[1:])]
        buckets[k] = [(x >> 20) % importance.BUCKETS for x in one + two]
    good_ids = {k for k in range(20, 60) if k % 2 == 0} | {3}
    raw, good = collections.Counter(), collections.Counter()
    for k, *_ in rows:
        raw.update(buckets[k])
        if k in good_ids:
            good.update(buckets[k])
    n, m = sum(good.values()), sum(raw.values())
    ratio = {b: math.log((good[b] + 1) / (n + importance.BUCKETS)) - math.log((raw[b] + 1) / (m + importance.BUCKETS)) for b in raw}
    for r in got:
        assert r.n_grams == len(buckets[r.doc_id])
        assert r.log_weight == pytest.approx(sum(ratio[b] for b in buckets[r.doc_id]), abs=1e-9)
    order = sorted((r.log_weight + r.gumbel for r in got), reverse=True)
    least = order[math.ceil(0.4 * len(got)) - 1]
    assert all(r.kept == (r.log_weight + r.gumbel >= least) for r in got)
    assert len({r.gumbel for r in got}) == len({r.doc_id for r in got})


def test_gumbel_noise_samples_in_proportion():
    """The row of largest sum is drawn in proportion to its weight."""
    log_weight, wins = np.log(np.array([1.0, 2.0, 5.0])), np.zeros(3)
    for seed in range(4000):
        draw = importance.mix(importance.mix(np.arange(3).astype(np.uint64)) + np.uint64(seed))
        noise = -np.log(-np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)))
        wins[np.argmax(log_weight + noise)] += 1
    assert np.abs(wins / 4000 - np.array([1, 2, 5]) / 8).max() < 0.03


def test_options_of_the_rules_reach_the_verdict(spark):
    """Other columns, strata and rules than the shipped ones."""
    rule = quality_rules.Rule("short_lines", "n_lines", "n_words", (0.5, 0.25))
    clean, junk = "plain words that say something in one long line of a text", "".join(f"a{i} b{i}\n" for i in range(9))
    rows = [(k, clean if k < 300 else f"{junk} {k}", "xx") for k in range(400)]
    docs = spark.createDataFrame(rows, "k long, t string, l string")
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(350)], "doc_id long, quality int, toxic int")
    options = {"id_col": "k", "lang_col": "l", "text_col": "t", "strata": ("xx",), "rules": (rule,), "risk": 0.05}
    got = {r.k: r.kept for r in quality_rules.quality_report(docs, labels, **options).collect() if not r.base_failed}
    assert got and all(kept == (k < 300) for k, kept in got.items()) and any(k >= 350 for k in got)
    assert {r.k for r in quality_rules.quality_filter(docs, labels, **options).collect()} == {k for k, kept in got.items() if kept}


def test_certified_cutoffs_reject_junk(spark):
    """With enough labels a rule is certified, rejects labelled and unlabelled junk, and spares what is clean; a label counts once."""
    need = quality_rules.labels_needed()
    assert (1 - 0.005) ** need <= 0.0025 < (1 - 0.005) ** (need - 1)
    clean = "these are plain words of a clean text which says something at some length here"
    junk = "word #$%& " * 12 + clean
    rows = [(k, clean if k < need + 50 else junk, "en", "s", 1, 1, "", "", "") for k in range(need + 150)]
    docs = table(spark, rows)

    def labels(n):
        return spark.createDataFrame([(k, 1, 0) for k in range(n)] + [(k, 0, 0) for k in range(need + 50, need + 100)], "doc_id long, quality int, toxic int")

    got = quality_rules.quality_report(docs, labels(need)).collect()
    assert all(r.kept == (r.doc_id < need + 50) for r in got if not r.base_failed)
    few = quality_rules.quality_report(docs, labels(need - 1)).collect()
    assert all(r.kept != r.base_failed for r in few)
    repeated = quality_rules.quality_report(docs.unionByName(docs.where("doc_id < 10")), labels(need - 1)).collect()
    assert all(r.kept != r.base_failed for r in repeated)


def test_document_scores_are_sums_over_segmentations(spark):
    """The score of each document against a plain recursion over its words with the same piece counts."""
    rows = [r for r in documents() if r[0] is not None and r[0] not in (11, 12)]
    got = {r.doc_id: r for r in lattice_lm.lm_scores(table(spark, rows), PIECES).collect()}
    pieces = lattice_lm.Pieces(PIECES)
    counts, ends = np.full(len(pieces.names), lattice_lm.PRIOR), 0
    words_of = {k: [w.decode() for w in lowered(t)] for k, t, *_ in rows}
    for k, *_ in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            ends += 1
            for w in words_of[k]:
                for i in pieces.model.encode(w):
                    counts[i] += 1
    counts[pieces.end] += ends
    scored = pieces.scored(np.log(counts / counts.sum()))
    for k, r in got.items():
        want = sum(scored.word(w) for w in words_of[k]) + math.log(counts[pieces.end] / counts.sum())
        assert r.score == pytest.approx(want / math.log(10), rel=1e-9)


def test_kth_largest(spark):
    x = np.concatenate([np.random.default_rng(2).normal(size=500) * 1e3, [0.0, -0.0, 7.5, 7.5, -1e300]])
    longs = importance.ordered(x)
    df = spark.createDataFrame([(int(v),) for v in longs], "v long")
    for k in (1, 2, 250, len(x)):
        assert importance.kth_largest(df, "v", k) == sorted(longs.tolist(), reverse=True)[k - 1]
    assert (np.argsort(longs, kind="stable") == np.argsort(x, kind="stable")).all()


def check_packs(spark, library, rows, **options):
    got = packing.pack(table(spark, rows), TOKENIZER, **options).collect()
    want = collections.Counter()
    ids = {}
    for k, text, *_ in rows:
        ids[k] = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[k] += len(ids[k])
    have, seqs = collections.Counter(), collections.defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        have[r.doc_id] += r.length
        seqs[r.sequence_id].append(r)
    assert have == want
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    return got


def test_packing(spark, library):
    check_packs(spark, library, documents())
    check_packs(spark, library, documents(), pack_tokens=4096)
    check_packs(spark, library, documents(), targets={"s0": 0.5, "s1": 0.3})
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0


def test_windows_follow_targets(spark, library):
    rows = [(k, " ".join(["word"] * 900), "en", f"s{k % 2}", 1, 1, "", "", "") for k in range(80)]
    got = check_packs(spark, library, rows, targets={"s0": 0.25, "s1": 0.75})
    first = collections.Counter()
    for r in got:
        if r.sequence_id & 0xFFFFFFFF < 10:
            first[r.doc_id % 2] += r.length
    assert first[0] / sum(first.values()) == pytest.approx(0.25, abs=0.01)


@pytest.mark.parametrize("targets, power", [({"s0": 0.2, "s1": 0.5, "s2": 0.3}, 1.0), ({"s0": 0.6}, 1.0), (None, 0.5)])
def test_every_pack_keeps_its_targets(spark, library, targets, power):
    """Targets away from the supply, over many packs: each window has its target mix until a source is dry everywhere; then the others share in proportion."""
    r = np.random.default_rng(4)
    rows = [(k, " ".join(["word"] * int(n)), "en", f"s{s}", 1, 1, "", "", "") for k, (n, s) in enumerate(zip(r.integers(1, 1500, 400), r.choice(3, 400, p=[0.5, 0.3, 0.2])))]
    source = {k: s for k, _, _, s, *_ in rows}
    got = packing.pack(table(spark, rows).repartition(5), TOKENIZER, targets=targets, power=power, pack_tokens=16384).collect()
    supply = collections.Counter()
    for k, text, *_ in rows:
        supply[source[k]] += len(text.split()) + 1
    share = packing.shares(dict(supply), targets, power)
    windows = collections.defaultdict(collections.Counter)
    for x in got:
        windows[x.sequence_id][source[x.doc_id]] += x.length
    assert len({s >> 32 for s in windows}) > 5
    seen = collections.Counter()
    for seq in sorted(windows):
        live = {s for s in supply if seen[s] + 2048 < supply[s]}
        mine = windows[seq]
        if len(live) == len(supply) and sum(mine.values()) == 2048:
            for s in supply:
                assert abs(mine[s] / 2048 - share[s]) < 0.02
        seen.update(mine)
    assert collections.Counter({s: sum(w[s] for w in windows.values()) for s in supply}) == supply


def test_deficits_stay_below_a_window():
    mix = packing.Mixture(np.array([50_000, 30_000, 7, 20_000]), np.array([0.1, 0.4, 0.2, 0.3]), 16384)
    for q in range(4):
        low = [int(mix.low(q, np.array([k]))[0]) for k in range(mix.packs + 1)]
        assert low[0] == 0 and low[-1] == mix.totals[q] and low == sorted(low)
        at = np.arange(mix.totals[q])
        assert (mix.packs_of(q, at) == np.searchsorted(low, at, "right") - 1).all()
    for k in range(mix.packs):
        queues = {}
        for q in range(4):
            n = np.diff(mix.low(q, np.array([k, k + 1])))[0]
            if n:
                queues[q] = packing.Queue(0, n)
        for _ in packing.fill(mix, k, queues, 2048):
            assert all(abs(q.deficit) < 2048 for q in queues.values())
        assert all(abs(q.deficit) < 8 for q in queues.values())


def test_packs_of_documents_without_words(spark):
    """A pack may hold as many documents as tokens: they stay numbers, and all of them come out."""
    import tracemalloc

    n = 1 << 20
    mix = packing.Mixture(np.array([n]), np.array([1.0]), packing.PACK_TOKENS)
    cols = [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64)), pa.array(np.full(n, 2, np.int32)), pa.array([b"\x01\x00"] * n, pa.binary())]
    batch = pa.record_batch(cols, ["pack", "queue", "doc_id", "start", "n", "width", "ids"])
    tracemalloc.start()
    seen = 0
    for out in packing._pack(mix, 2048)(iter([batch])):
        assert (out.column(0).to_numpy() == np.arange(seen, seen + out.num_rows)).all() and set(out.column(2).to_pylist()) == {1}
        assert (out.column(5).to_numpy() * 2048 + out.column(6).to_numpy() == np.arange(seen, seen + out.num_rows)).all()
        seen += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 125e6  # a quarter of a pack's tokens in a quarter of 500 MB


def test_bases_are_running_sums(spark):
    r = np.random.default_rng(6)
    rows = [(p, f"s{s}", s % 3, int(r.integers(1, 50))) for p in range(300) for s in range(5) if r.random() < 0.7]
    want, now = {}, {}
    for p, s, q, n in sorted(rows):
        want[p, s] = now.get(q, 0)
        now[q] = want[p, s] + n
    got = packing._bases(spark.createDataFrame(rows, "part long, source string, queue int, n long")).collect()
    assert {(x.part, x.source): x.base for x in got} == want


def test_encoder_is_the_library(library):
    r = np.random.default_rng(3)
    parts = [*"abcXYZ019 .,'<|>!?-_", "\n", "\t", "é", "É", "ß", "×", "÷", "İ", "\u0301", "日", "\x1c", "\xa0", "ŉ", "<|endoftext|>", "<|EndOfText|>", "n't", "²", "ǅ", "Σ", "\u2003", "\u024f", "\u0250"]
    texts = ["".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 60))) for _ in range(3000)] + [None, "", " ", "x" * 5000]
    ids, at = encoder.Encoder(TOKENIZER)(pa.array(texts, pa.string()))
    for k, x in enumerate(texts):
        assert library.encode(x or "", add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist()
    assert len(encoder.Encoder(TOKENIZER)(pa.array([], pa.string()))[0]) == 0
