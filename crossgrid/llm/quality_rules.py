"""Quality rules with risk-controlled thresholds.

Every rule is a number that is higher for worse texts. Its cutoff is chosen on labelled rows,
per stratum, from a fixed grid that is walked from lenient to strict: a cutoff is certified while
the exact binomial tail of its false rejections refutes "more than the allowed share of good
texts is rejected". The error budget is divided among all strata and rules (Bonferroni), and the
walk stops at the first failure, so all certified cutoffs hold at once. Of them the one of greatest
use on the labels is taken; where none is of use, the rule rejects nothing in that stratum.

Defined results: null and empty texts have no words and fail the base rule; a row with null or
unknown language is of stratum "other"; rows are judged one by one, so repeated rows and ties have
equal verdicts; several labels of one id count as the worst, and its rows as one draw; unlabelled and null-labelled rows do
not vote; with no labels nothing but the base rule rejects; other columns are kept as they are by
the filter, whatever their names, and not read. A stratum can be certified from ``labels_needed()`` good labels on, 1,196 as shipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, prepare, stash, tidy
from .words import Words, _SPACE, grams, mix, slices

#: The symbols that count, and the base rule's limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
STRATA = ("en", "fr", "de", "es")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_CHAR = ((np.arange(256) & 0xC0) != 0x80) & ~_SPACE
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeated_words(w: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in windows which occur twice or more in it."""
    n = len(w.start)
    if n < window:
        return np.zeros(len(w.first) - 1, np.int64)
    doc = w.doc()
    h = grams(w.hash, window)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = mix(h[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return _per_text(np.cumsum(edge[:n]) > 0, w.first)


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text of a string column."""
    w = Words(column)
    lines, dup = [], []
    data = w.bytes.tobytes()
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        with_word = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines.append(len(with_word))
        dup.append(len(with_word) - len(set(with_word)))
    return [w.counts(), _per_text(_CHAR[w.bytes], w.offsets), _per_text(_SYMBOL[w.bytes], w.offsets), np.array(dup, np.int64), repeated_words(w), np.array(lines, np.int64)]


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all: null) and the long columns COUNTS, prefixed ``_q_``; no shuffle."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_q_text"))
    n = len(keep)
    fields = [*rows.schema.fields[:n]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"_q_{c} bigint" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(n)):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), *(pa.array(c, pa.int64()) for c in text_counts(part.column(n)))], [*(part.schema.names[:n]), *(f"_q_{c}" for c in COUNTS)])

    return rows.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    n, r = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED_PERCENT * n)


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts, rejected above a cutoff of the grid (lenient to strict)."""

    name: str
    over: str
    under: str
    grid: tuple[float, ...]

    def value(self) -> Column:
        return F.col(f"_q_{self.over}") / F.greatest(F.col(f"_q_{self.under}"), F.lit(1))


RULES = (
    Rule("symbols", "n_symbols", "n_words", tuple(x / 50 for x in range(50, 0, -1))),
    Rule("same_lines", "n_dup_lines", "n_lines", tuple(x / 40 for x in range(36, 0, -1))),
    Rule("repeats", "n_repeat_words", "n_words", tuple(x / 50 for x in range(10, 0, -1))),
    Rule("long_words", "word_chars", "n_words", tuple(x / 2 for x in range(60, 12, -1))),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Bin(n, p): the incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
        out = d
        for m in range(1, 100_000):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-13:
                break
        return out

    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, p) / b


def labels_needed(risk: float = 0.02, error: float = 0.05, rules: int = len(RULES), strata: int = len(STRATA) + 1) -> int:
    """Good labels of a stratum from which on a cutoff that rejects none of them is certified: (1 - p)^n is at most the error."""
    return math.ceil(math.log(error / (strata * rules)) / math.log1p(-risk / rules))


def choose(bins: dict[int, tuple[int, int]], grid: tuple[float, ...], risk: float, error: float, cost: float) -> float | None:
    """The cutoff of greatest use among those certified. bins: by number of grid cutoffs that a value exceeds, the good and the bad rows."""
    good = sum(g for g, _ in bins.values())
    best, found, g, b = 0.0, None, 0, 0
    for i, cutoff in enumerate(grid):
        # cutoffs come strictest last: a value exceeds cutoff i if it exceeds at least len(grid) - i of them
        g, b = (sum(v[k] for e, v in bins.items() if e >= len(grid) - i) for k in (0, 1))
        if not good or binomial_tail(g, good, risk) > error:
            break
        if (use := b - cost * g) > best:
            best, found = use, cutoff
    return found


def fit_cutoffs(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", strata: tuple[str, ...] = STRATA, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05, cost: float = 20.0) -> dict[tuple[str, str], float]:
    """By stratum and rule the cutoff. risk: share of good texts that all rules together may reject; error: chance that any stratum exceeds it; cost: rejected bad texts that outweigh one good text."""
    strata = (*strata, "other")
    votes = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("long").alias("_q_id")).agg(F.min("quality").alias("_q_good"))
    rows = counted.where(~base_failed()).select(F.col(id_col).cast("long").alias("_q_id"), stratum(lang_col, strata).alias("_q_stratum"), *(sum(((r.value() > c).cast("int") for c in r.grid), F.lit(0)).alias(f"_q_r_{r.name}") for r in rules)).join(votes, "_q_id")
    # rows with one id are one draw: the label votes once, with the worst of their values
    rows = rows.groupBy("_q_id", "_q_good").agg(F.min("_q_stratum").alias("_q_stratum"), *(F.max(f"_q_r_{r.name}").alias(f"_q_r_{r.name}") for r in rules))
    parts = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"_q_r_{r.name}").alias("bin")) for r in rules)))
    seen = rows.select("_q_stratum", "_q_good", parts.alias("x")).groupBy("_q_stratum", "x.rule", "x.bin").agg(F.sum((F.col("_q_good") >= 1).cast("long")), F.sum((F.col("_q_good") < 1).cast("long")))
    by: dict[tuple[str, str], dict[int, tuple[int, int]]] = {}
    for s, rule, e, good, bad in seen.collect():  # at most strata x rules x (grid + 1) rows
        by.setdefault((s, rule), {})[e] = (good, bad)
    found = {(s, r.name): choose(by.get((s, r.name), {}), r.grid, risk / len(rules), error / (len(strata) * len(rules)), cost) for s in strata for r in rules}
    return {k: v for k, v in found.items() if v is not None}


def stratum(lang_col: str, strata: tuple[str, ...]) -> Column:
    lang = F.col(lang_col).cast("string")
    return F.when(lang.isin(*strata), lang).otherwise(F.lit("other"))


def kept(cutoffs: dict[tuple[str, str], float], lang_col: str = "lang", strata: tuple[str, ...] = STRATA, rules: tuple[Rule, ...] = RULES) -> Column:
    """The verdict on rows of with_counts()."""
    out = ~base_failed()
    for r in rules:
        limit = F.lit(None).cast("double")
        for s in (*strata, "other"):
            if (s, r.name) in cutoffs:
                limit = F.when(stratum(lang_col, (*strata, "other")) == s, F.lit(cutoffs[s, r.name])).otherwise(limit)
        out = out & ~F.coalesce(r.value() > limit, F.lit(False))
    return out


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", strata: tuple[str, ...] = STRATA, rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """Per row: the id, the counts, base_failed, kept. Texts are read once; their counts are stashed for fitting and verdicts. labels have their ids as doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = stash(with_counts(rows, keep=["doc_id", "lang"]))
    cutoffs = fit_cutoffs(counted, labels, strata=strata, rules=rules, **options)
    return counted.select(F.col("doc_id").alias(id_col), *(F.col(f"_q_{c}").alias(c) for c in COUNTS), base_failed().alias("base_failed"), kept(cutoffs, "lang", strata, rules).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", strata: tuple[str, ...] = STRATA, rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Texts are read twice, and never shuffled. labels have their ids as doc_id."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    cutoffs = fit_cutoffs(with_counts(given, keep=["doc_id", "lang"]), labels, strata=strata, rules=rules, **options)
    rows, at = numbered(docs)
    return with_counts(rows, at[text_col]).where(kept(cutoffs, at[lang_col], strata, rules)).select(*rows.columns).toDF(*docs.columns)
