"""Quality classification by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of a target (texts labelled
good) and one of all raw texts, give each text the log ratio of its likelihoods. Gumbel noise, drawn from
a hash of the id, is added, and the k rows of largest sum are kept: a sample without replacement
in proportion to the ratio. k is found exactly by counting digits of the sums, whatever the number of rows.

The target is fitted on at most ``max_labels`` labelled rows, those of smallest id hash; the raw model
counts every row. With a share, k is that share of the rows: a resampling proper. Without one k follows from labels, for a filter that
must keep good rows: the largest k that leaves all but ``spare`` of the good
rows among those, a HELD_OUT share by another hash of the id, that the target was not fitted on. A report has both, of one drawing.

Defined results: null, empty and wordless texts have log ratio 0; equal rows have equal sums and share a verdict, so ties
at the k-th place all stay; rows without an id share the noise of id 0; rows without labels count in the raw model alone; with no good labels all
ratios are 0 and, unless a share is given, all rows stay; an empty table gives an empty result; other columns are kept as they are by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, numbered, prepare, stash, tidy
from .words import Words, grams, mix, slices

BUCKETS, SMOOTH, MAX_LABELS = 10_000, 1.0, 20_000
#: Share of the labelled rows that set k and do not fit the target.
HELD_OUT = 0.25
#: Share of the rows that a report's resampling keeps.
SAMPLED = 0.5
FIELDS = [("_log_weight", "double", pa.float64()), ("_gumbel", "double", pa.float64()), ("_order", "bigint", pa.int64()), ("_n_grams", "bigint", pa.int64())]


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram, and the text that each is of."""
    doc, h = w.doc(), w.hash
    two = np.flatnonzero(doc[1:] == doc[:-1])
    found = np.concatenate([h, grams(h, 2)[two] if len(two) else h[:0]])
    return ((found >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[two]])


def sample(labels: DataFrame, id_col: str, most: int) -> np.ndarray:
    """Ids of good labelled rows, of the ``most`` labelled ones of smallest hash."""
    rows = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min("quality") >= 1).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array(sorted(r.id for r in got if r.good and not r.toxic), np.int64)


def held(ids: np.ndarray) -> np.ndarray:
    """Which of these ids are held out, by a hash."""
    return (mix(ids.astype(np.uint64) + np.uint64(29)) >> np.uint64(11)).astype(float) / (1 << 53) < HELD_OUT


def _within(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.isin(ids, some, assume_unique=False)


def fit(docs: DataFrame, target: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """By bucket the log ratio of target and raw probability. Each task sends one count per bucket; BUCKETS rows come to the driver."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i, j in slices(b.column(1)):
                at, doc = buckets(Words(b.column(1).slice(i, j - i), lower=True))
                raw += np.bincount(at, minlength=BUCKETS)
                ids = b.column(0).slice(i, j - i).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
                good += np.bincount(at[_within(ids, target)[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(raw[some])], ["bucket", "good", "all"])

    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "bucket int, good long, all long")
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("all").alias("raw")).collect():
        good[r.bucket], raw[r.bucket] = r.good, r.raw
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + SMOOTH) / (good.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def ordered(x: np.ndarray) -> np.ndarray:
    """Longs in the order of doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def with_weights(docs: DataFrame, ratio: np.ndarray, keep: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The columns ``keep`` and FIELDS: the log ratio, the noise, their sum as a long in the same order, and the n-grams of the text."""

    def scored(text: pa.Array, ids: pa.Array) -> list[np.ndarray]:
        w = Words(text, lower=True)
        at, doc = buckets(w)
        weight = np.bincount(doc, ratio[at], minlength=len(text))
        draw = mix(mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) + np.uint64(seed))
        noise = -np.log(-np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)))
        return [weight, noise, ordered(weight + noise), np.bincount(doc, minlength=len(text))]

    return append(docs, keep, [F.col(text_col).cast("string"), F.col(id_col).cast("long")], FIELDS, scored)


def kth_largest(rows: DataFrame, col: str, k: int) -> int:
    """The k-th largest of a long column: four counts of 16 bits each, of 65,536 rows at most."""
    prefix, value = None, F.col(col)
    for shift in (48, 32, 16, 0):
        some = rows if prefix is None else rows.where(F.shiftright(value, shift + 16) == prefix)
        digit = F.shiftright(value, shift)
        for d, n in sorted(((r[0], r[1]) for r in some.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if k <= n:
                prefix = d
                break
            k -= n
    return prefix


def cutoff(scores: DataFrame, good: np.ndarray, share: float | None, spare: float, id_col: str) -> int | None:
    """The least kept value of _order, by a share of the rows or by good rows that are to stay; null where all rows stay."""
    n = scores.count()
    if not n:
        return None
    if share is None:
        if not len(good):
            return None
        # labelled rows are few: at most max_labels of them come here
        ids = scores.sparkSession.createDataFrame([(int(i),) for i in good], "_l_id long")
        kept = sorted(r._order for r in scores.join(ids, scores[id_col].cast("long") == ids["_l_id"]).select("_order").collect())
        if not kept:
            return None
        at = kept[math.floor(spare * len(kept))]
        k = scores.where(F.col("_order") >= at).count()
    else:
        k = math.ceil(share * n)
    return kth_largest(scores, "_order", max(1, k)) if k < n else None


def resample(docs: DataFrame, labels: DataFrame, keep: list[str], share: float | None = None, spare: float = 0.002, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores of all rows (the columns ``keep``, among them the id, and FIELDS), the ratios, and the good rows that were held out."""
    good = sample(labels, label_id, max_labels)
    apart = held(good)
    ratio = fit(docs, good[~apart] if share is None else good, id_col, text_col)
    return stash(with_weights(docs, ratio, keep, id_col, text_col)), ratio, good[apart]


def importance_report(docs: DataFrame, labels: DataFrame, share: float | None = None, spare: float = 0.002, sampled: float = SAMPLED, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: the id, n_grams, log_weight, gumbel, kept (by the share, or else by what good rows ask for) and sampled (the share ``sampled`` of all rows that has the largest sums)."""
    scores, _, good = resample(docs, labels, [id_col], share, spare, id_col=id_col, **options)
    above = lambda least: F.lit(True) if least is None else F.col("_order") >= least
    kept, drawn = (above(cutoff(scores, good, x, spare, id_col)) for x in (share, sampled))
    return scores.select(id_col, F.col("_n_grams").alias("n_grams"), F.col("_log_weight").alias("log_weight"), F.col("_gumbel").alias("gumbel"), kept.alias("kept"), drawn.alias("sampled"))


def importance_filter(docs: DataFrame, labels: DataFrame, share: float | None = None, spare: float = 0.002, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are read once more rather than shuffled."""
    scores, ratio, good = resample(docs, labels, [id_col], share, spare, id_col=id_col, text_col=text_col, **options)
    least = cutoff(scores, good, share, spare, id_col)
    if least is None:
        return docs
    rows, at = numbered(docs)
    return with_weights(rows, ratio, rows.columns, at[id_col], at[text_col]).where(F.col("_order") >= least).select(*rows.columns).toDF(*docs.columns)
