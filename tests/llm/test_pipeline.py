"""The pipeline's stages, one after the other, against plain Python over whole documents: the exact rows that each keeps."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crossgrid.llm import importance, quality_rules, substring_dedup
from crossgrid.llm.words import Words

from .fixtures import TOKENIZER, table, words
from .test_duplicates import brute, edited, plain_removal
from .test_text_operators import brute_counts

GOOD = 1250


def planted():
    """id: text, and labels. Clean texts, symbols without sense, texts too short or of repeated words, near and exact copies, passages that several texts share."""
    texts = {k: " ".join(words(k, 24)) for k in range(GOOD)}
    for k in range(60):
        texts[2000 + k] = "# $ % & | < > * " * 3 + " ".join(words(3000 + k, 14))
    texts |= {2100: "too short", 2101: "one two three four five " * 9, 2102: None, 2103: ""}
    for g in range(3):
        texts |= {2200 + 20 * g + k: t for k, t in enumerate(edited(g, words(4000 + g, 90), 8, 1))}
        texts[2219 + 20 * g] = texts[2200 + 20 * g]
    passages = [words(5000 + j, 70) for j in range(3)]
    for k in range(24):
        texts[2300 + k] = " ".join(words(6000 + k, 30) + passages[k % 3] + words(7000 + k, 12 + k))
    labels = {k: (1, 0) for k in texts if k < GOOD or k >= 2200} | {k: (0, 0) for k in range(2000, 2040)} | {2300: (1, 1)}
    return texts, labels


def rules_of(texts, labels):
    """Ids that no certified cutoff and no base rule rejects; only English has labels."""
    counts = {k: (*brute_counts(t), max(1, len([x for x in (t or "").split("\n") if x.split()]))) for k, t in texts.items()}
    value = {
        "symbols": lambda c: c[2] / max(c[0], 1), "same_lines": lambda c: c[3] / c[5], "repeats": lambda c: c[4] / max(c[0], 1), "long_words": lambda c: c[1] / max(c[0], 1),
    }
    left = {k for k, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    out = set(left)
    for rule in quality_rules.RULES:
        good = [value[rule.name](counts[k]) for k in left if labels.get(k, (None,))[0] == 1]
        bad = [value[rule.name](counts[k]) for k in left if labels.get(k, (None,))[0] == 0]
        best, cutoff = 0, None
        for c in rule.grid:
            wrong = sum(v > c for v in good)
            tail = sum(math.comb(len(good), i) * 0.005**i * 0.995 ** (len(good) - i) for i in range(wrong + 1))
            if tail > 0.05 / 20:
                break
            use = sum(v > c for v in bad) - 20 * wrong
            if use > best:
                best, cutoff = use, c
        if cutoff is not None:
            out -= {k for k in left if value[rule.name](counts[k]) > cutoff}
    return out


def classified(texts, labels):
    """Ids whose log ratio and noise, together, are at least those of the good rows that were held out, all but 0.2 %."""
    good = sorted(k for k, (q, toxic) in labels.items() if q == 1 and not toxic)
    apart = dict(zip(good, importance.held(np.array(good)).tolist()))
    grams = {}
    for k, t in texts.items():
        w = Words(pa.array([t], pa.string()), lower=True)
        grams[k] = importance.buckets(w)[0].tolist()
    raw, target = collections.Counter(x for g in grams.values() for x in g), collections.Counter(x for k in good if k in grams and not apart[k] for x in grams[k])
    n, m = sum(target.values()) + importance.BUCKETS, sum(raw.values()) + importance.BUCKETS
    ratio = {b: math.log((target[b] + 1) / n) - math.log((raw[b] + 1) / m) for b in raw}
    total = {}
    for k, g in grams.items():
        draw = importance.mix(importance.mix(np.array([k]).astype(np.uint64)) + np.uint64(7))
        noise = -math.log(-math.log((float(draw[0] >> np.uint64(11)) + 0.5) / (1 << 53)))
        total[k] = sum(ratio[x] for x in g) + noise
    held = sorted(total[k] for k in good if apart[k] and k in total)
    least = held[math.floor(0.002 * len(held))]
    return {k for k, v in total.items() if v >= least - 1e-9}


def test_stages_keep_the_rows_of_plain_python(spark, tmp_path):
    import corpus_pipeline

    texts, labels = planted()
    table(spark, [(k, t, "en", f"s{k % 3}", len(t or ""), 1, "", "", "") for k, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, x) for k, (q, x) in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = rules_of(now, labels)
            assert set(rows) == want and not want & set(range(2000, 2060)) and want >= set(range(GOOD)) | set(range(2200, 2324)) & set(texts)
        elif name == "quality_classifier":
            want = classified(now, labels)
            assert set(rows) == want and len(want) > 0.9 * len(now)
        elif name == "near_duplicates":
            classes = brute([(k, t) for k, t in now.items()], 5, 80)
            want = {k for k, (_, c) in classes.items() if c == k}
            assert set(rows) == want and len(now) - len(want) >= 15
        else:
            plain, _ = plain_removal({k: t or "" for k, t in now.items()})
            want = {k: len(now[k].split()) - gone for k, ((gone, _), _) in plain.items()}
            assert {k: len(t.split()) for k, t in rows.items()} == want and sum(len(now[k].split()) - n for k, n in want.items()) >= 15 * 60
        if name != "substring_dedup":
            assert all(rows[k] == texts[k] for k in rows)
        now = rows
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in now.items()}
    used = collections.Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert sum(n != 2048 for n in used.values()) <= 11 and max(used.values()) == 2048
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == set(now) and sum(r.length for r in run.collect()) == sum(got.values())


def test_expected_rows_are_no_trivial_ones():
    texts, labels = planted()
    kept = rules_of(texts, labels)
    assert len(texts) - len(kept) >= 64 and pytest.approx(1) == len(kept & set(range(GOOD))) / GOOD
