"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the bytes of a text; where its top bits vanish at the end of a word, a
chunk ends, so chunks move with their content and an insertion changes only those that it touches.
The hash looks back 16 bytes, hence cuts agree again soon after the start of a shared passage. Each chunk
is taken with the next ones up to LEAST words and named by a digest of these words; of equal digests
the first in order of doc_id (and, inside a document, of position) stays, and where removed runs cover
SPAN words or more, their text goes.

Scale: a slice of the input settles what it can by itself and sends each digest once, so a passage
that is in a third of all documents reaches its task once per slice, not once per document. Digests are
64-bit: a run is removed wrongly with chance n / 2^64 for n digests.

Defined results: null stays null, texts without words stay as they are; rows with one id are one document and are not
compared with each other; a null id counts as -1 and such rows stay as they are; texts of fewer than LEAST words are never shortened; a row whose words all go has
an empty text; empty tables give empty results; in a report, ADDED replaces columns of these names; all other columns are kept as they are, but for
``n_chars`` where the input has it, which follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, prepare, tidy
from .words import Words, mix, slices

#: A cut follows a word with chance 1 / 2^CUT_BITS; words of a unit; words of a removed run.
CUT_BITS, LEAST, SPAN = 2, 12, 16
LOOK_BACK = 16
NEAR = 12
ADDED = ("_n_words", "_n_removed", "_n_runs", "_first_ids")
#: Units that a task settles together.
GATHER = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(5150)).integers(0, 1 << 16, 256).astype(np.uint16)
_STEP = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 16-bit rolling hash g = 2 g + gear[byte] at each byte, of its text's last 16 bytes: by doubling the window."""
    n = len(offsets) - 1
    at = np.arange(len(data)) + LOOK_BACK * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    h = np.zeros(len(data) + LOOK_BACK * (n + 1), np.uint16)
    h[at] = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h[at]


def _powers(n: int) -> list[np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS = []
        for step in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


class Units:
    """Of a batch of texts: per unit its text, first word, word after its last, and digest."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column)
        n = len(w.start)
        self.doc = self.start = self.end = np.zeros(0, np.int64)
        self.digest = np.zeros(0, np.int64)
        if not n:
            return
        doc = w.doc()
        h = gear(w.bytes, w.offsets)[w.end - 1]
        cut = np.zeros(n + 1, bool)  # before a word
        cut[1:] = (h >> np.uint16(16 - CUT_BITS)) == 0
        # where a text repeats a few words for long, the hash may never vanish: its minima over NEAR words either way cut as well
        wide = np.pad(h, NEAR, constant_values=(1 << 16) - 1)
        low = wide.copy()
        for k in (1, 2, 4, 8, 2 * NEAR + 1 - 16):
            low = np.minimum(low[:-k], low[k:])
        cut[1:] |= h == low
        cut[w.first] = True
        cuts = np.flatnonzero(cut)
        start = cuts[cuts < n]
        end = cuts[np.minimum(np.searchsorted(cuts, start + LEAST), len(cuts) - 1)]
        whole = (end - start >= LEAST) & (end <= w.first[doc[start] + 1])
        self.start, self.end = start[whole], end[whole]
        self.doc = doc[self.start]
        p, q = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w.hash * p[:n], dtype=np.uint64, out=sums[1:])
        self.digest = mix((sums[self.end] - sums[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64)).astype(np.int64)


def _settled(doc: np.ndarray, known: np.ndarray, row: np.ndarray, digest: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Marks of units: the first of each digest is open; others of rows with an id are known to repeat it, unless it is in another row of their own document."""
    order = np.lexsort((start, doc, digest))
    doc, known, row, digest = doc[order], known[order], row[order], digest[order]
    head = np.concatenate([[True], digest[1:] != digest[:-1]])
    first = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    show = head | known & ((doc != first) | np.concatenate([[False], row[1:] == row[:-1]]))
    spread = mix(doc.astype(np.uint64)).astype(np.int64)
    return pa.record_batch([pa.array(np.where(head, digest, spread)[show]), pa.array(head[show]), pa.array(doc[show]), pa.array(digest[show]), pa.array(first[show])], ["key", "open", "doc", "digest", "first"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to rows (key, open, doc, digest, first): open ones, one for each digest of a slice, have still to be compared with other slices by key; the others are known to repeat ``first``. Units are made of small pieces and gathered, as a few numbers each, to slices of GATHER of them."""
    kept, rows, n = [], 0, 0
    for b in batches:
        for i, j in slices(b.column(1)):
            u, ids = Units(b.column(1).slice(i, j - i)), b.column(0).slice(i, j - i)
            if len(u.digest):
                kept.append((ids.fill_null(-1).to_numpy(zero_copy_only=False)[u.doc], ids.is_valid().to_numpy(zero_copy_only=False)[u.doc], rows + u.doc, u.digest, n + u.start))
                n += len(u.words.start)
            rows += j - i
            if sum(len(x[0]) for x in kept) >= GATHER:
                yield _settled(*(np.concatenate(x) for x in zip(*kept)))
                kept = []
    if kept:
        yield _settled(*(np.concatenate(x) for x in zip(*kept)))


def spans(start: np.ndarray, end: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Unions of word ranges that come in order of start, those of ``least`` words or more."""
    out: list[list[int]] = []
    for a, b in zip(start.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def shorten(text: str, gone: set[int], span: int = SPAN) -> tuple[str, int, int, int, set[int]]:
    """A text without its repeated runs; its words, the words removed, the runs removed, and the digests in them. gone: digests that an earlier document has."""
    u = Units(pa.array([text], pa.string()))
    w, seen, again = u.words, set(), np.zeros(len(u.digest), bool)
    for k, d in enumerate(u.digest.tolist()):
        again[k] = d in gone or d in seen
        seen.add(d)
    out, at, removed, data = [], 0, 0, w.bytes.tobytes()
    runs = spans(u.start[again], u.end[again], span)
    for a, b in runs:
        out.append(data[at : w.start[a]])
        at = int(w.start[b]) if b < len(w.start) else len(data)
        removed += b - a
    out.append(data[at:])
    inside = again & (np.searchsorted([b for _, b in runs], u.start, "right") < len(runs)) if runs else again & False
    k = np.minimum(np.searchsorted([b for _, b in runs], u.start, "right"), len(runs) - 1)
    inside &= np.array([a for a, _ in runs])[k] <= u.start if runs else inside
    return b"".join(out).decode(), len(w.start), removed, len(runs), set(u.digest[inside].tolist())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = True) -> DataFrame:
    """All columns of docs with repeated passages taken out of the text, and, for a report, ADDED: _n_words, _n_removed, _n_runs, _first_ids (for each removed passage an earlier document that has it, the first of its slice at least, or the own one where it repeats itself)."""
    prepare(docs.sparkSession)
    plain, at = numbered(docs)
    doc, text = F.col(at[id_col]).cast("long"), F.col(at[text_col]).cast("string")
    marks = plain.select(doc.alias("doc"), text.alias("text")).mapInArrow(tidy(_marks), "key long, open boolean, doc long, digest long, first long")
    marks = marks.withColumn("first", F.when(F.col("open"), F.min("doc").over(Window.partitionBy("key", "open"))).otherwise(F.col("first"))).where("NOT open OR doc > first")
    lists = marks.groupBy(F.col("doc").alias("mark_id")).agg(F.collect_list("digest").alias("gone"), F.collect_list("first").alias("gone_first"))
    rows = plain.join(lists, doc == F.col("mark_id"), "left").select(*plain.columns, text.alias("old"), doc.alias("own"), "gone", "gone_first")
    n = len(plain.columns)
    added = ("new", *ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]), "new string, _n_words bigint, _n_removed bigint, _n_runs bigint, _first_ids array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(n)):
                part = b.slice(i, j - i)
                new, removed, runs, firsts = part.column(n).to_pylist(), [0] * (j - i), [0] * (j - i), [[] for _ in range(j - i)]
                words = Words(part.column(n), hashes=False).counts()
                for k in np.flatnonzero(part.column(n + 2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                    if new[k] is None:
                        continue
                    own, found = part.column(n + 1)[k].as_py(), list(zip(part.column(n + 2)[k].as_py(), part.column(n + 3)[k].as_py()))
                    new[k], _, removed[k], runs[k], went = shorten(new[k], {d for d, f in found if f != own})
                    before: dict[int, int] = {}
                    for d, f in found:
                        if d in went:
                            before[d] = min(before.get(d, f), f)
                    firsts[k] = sorted(set(before.values()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), pa.array(new, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], [*part.schema.names[:n], *added])

    out = rows.mapInArrow(tidy(run), schema)
    new = {c: F.col(k) for c, k in at.items()} | {text_col: F.col("new")}
    if "n_chars" in at:
        new["n_chars"] = F.when(F.col("_n_runs") > 0, F.length("new")).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(c) for c, v in new.items() if not (report and c in ADDED)), *(ADDED if report else ()))
