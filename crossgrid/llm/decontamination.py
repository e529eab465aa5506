"""Benchmark decontamination by an FM-index per shard of the training texts.

Words are lower-cased runs outside ASCII punctuation and space. An item of a benchmark gives its windows of WINDOW words; one
of fewer words is one window. A task cuts its documents into shards and names words by the vocabulary of the windows. Words that
no window has, and the ends of texts, end a run; a run shorter than the shortest window can't hold one. The
other runs become one string of symbols: its suffixes are sorted by prefix doubling, the symbols before them
go into a wavelet tree with rank directories, and every SAMPLE-th position of a run is kept. All windows
are searched backward together, one word at a time, by ranks; the rows that are left walk back to a sampled position, which
locates them; spans that meet or overlap are merged per document.

Scale: documents never move, and nothing is shuffled; copies of a passage cost their own words. Windows come to the tasks in blocks of BLOCK words
of the benchmark, a bound that does not grow with it, and each block is one more pass over rows that stay where they are; every
STASHED passes the rows are written. A window has at most one occurrence per position, so what is located is bounded by the shard.

Defined results: null, empty and wordless texts have no words, no spans and aren't contaminated; documents with null or repeated ids are rows like others;
a null item_id is an empty string, rows of one item_id are one item with the windows of each; equal windows count for all their items; items without words,
and an empty benchmark, contaminate nothing; empty tables give empty results; ADDED replaces columns of these names, all others stay. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, prepare, stash, tidy
from .words import Words, mix, raw, slices

WINDOW = 10
#: Benchmark words of a block; passes between two writes; every so many positions of a run one is kept.
BLOCK, STASHED, SAMPLE = 1 << 19, 4, 8
#: Benchmark words of a piece of a long item; symbols and text bytes of a shard.
PIECE, SHARD, SHARD_BYTES = 4096, 1 << 20, 8 << 20
ADDED = ("_n_words", "_n_hit", "_spans", "_items")

_APART = np.arange(256, dtype=np.uint8)
_APART[65:91] += 32
_APART[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def words(column: pa.Array) -> Words:
    """Words of texts, lower-cased: maximal runs outside ASCII other than letters and digits; UTF-8 keeps ASCII bytes apart from all others."""
    data, at = raw(column)
    return Words(pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at), pa.py_buffer(_APART[data])]))


class WaveletTree:
    """Symbols by their bits, from the highest down: each level keeps zeros before ones. Ranks count a symbol before a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, now = bits, [], symbols
        for k in reversed(range(bits)):
            one = (now >> np.uint32(k) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.concatenate([one, np.zeros(64 - len(one) % 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, len(one) - int(one.sum())))
            now = np.concatenate([now[~one], now[one]])

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        first, at = np.zeros_like(at), at
        for k, level in zip(reversed(range(self.bits)), self.levels):
            one = (symbols >> np.uint32(k) & np.uint32(1)).astype(bool)
            a, b = self._ones(level, first), self._ones(level, at)
            first, at = np.where(one, level[2] + a, first - a), np.where(one, level[2] + b, at - b)
        return at - first

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, first = np.zeros(len(at), np.uint32), np.zeros_like(at)
        for level in self.levels:
            one = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(level, first), self._ones(level, at)
            first, at = np.where(one, level[2] + a, first - a), np.where(one, level[2] + b, at - b)
            symbol = symbol << np.uint32(1) | one.astype(np.uint32)
        return symbol, at - first


def suffixes(text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a string of symbols from 1, with an end (0) after each run; ends compare by their place, so no comparison leaves a run. run: the place of each symbol's end."""
    n, bits = len(text), max(1, int(text.max(initial=1)).bit_length())
    per = max(1, min(4, 62 // bits))
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(per):
        key = key << bits | np.where(at + k < run, text[np.minimum(at + k, n - 1)].astype(np.int64), 0)
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], np.diff(key[order]) != 0]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    # those that tie go on with what stands ``per`` symbols further; one whose run has ended by then goes by its place
    while True:
        alone = head & np.concatenate([head[1:], [True]]) if n else head
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        s = order[open_]
        ended = s + per > run[s]
        nxt = np.where(ended, s - n, rank[np.minimum(s + per, n - 1)])
        again = np.lexsort((nxt, rank[s]))
        group, nxt = rank[s][again], nxt[again]
        order[open_] = s[again]
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        head[open_] = split
        new = np.maximum.accumulate(np.where(split, open_, 0))
        rank[order[open_]] = new
        per *= 2


class FMIndex:
    """Backward search and location in a string of runs, each closed by a 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        run = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        order = suffixes(text, run)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max(initial=1)).bit_length()))
        begin = np.concatenate([[0], ends[:-1] + 1])
        kept = (order - np.repeat(begin, np.diff(np.concatenate([[-1], ends])))[order]) % sample == 0
        packed = np.packbits(np.concatenate([kept, np.zeros(64 - n % 64, bool)]), bitorder="little").view(np.uint64)
        self.kept = (packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]), 0)
        self.samples = order[kept]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each window: rows of symbols, padded on the left."""
        m, most = windows.shape
        low, high = np.zeros(m, np.int64), np.full(m, self.less[-1])
        for k in range(most):
            live = np.flatnonzero((k < lengths) & (low < high))
            c = windows[live, most - 1 - k]
            known = c < len(self.less) - 1
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            # a symbol is counted before both ends of its range at once
            r = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.less[c] + r[: len(c)], self.less[c] + r[len(c) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the string of each row's suffix, by steps to the symbol before until one is sampled; the first of a run always is."""
        out, steps, at, now = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(now):
            there = (self.kept[0][now >> 6] >> (now & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[at[there]] = self.samples[WaveletTree._ones(self.kept, now[there])] + steps
            at, now, steps = at[~there], now[~there], steps + 1
            symbol, r = self.tree.access(now)
            now = self.less[symbol] + r
        return out


@dataclass(frozen=True)
class Windows:
    """Of a block: the vocabulary's hashes in order, distinct windows as symbols from 1 (padded on the left), their lengths, and their items."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    items: tuple[tuple[str, ...], ...]

    @staticmethod
    def of(pieces: list[tuple[str, bytes]], window: int = WINDOW) -> Windows | None:
        """From (item, hashes of the words of a piece); a piece of fewer words than a window is one window."""
        rows: dict[bytes, set[str]] = {}
        for item, data in pieces:
            n, one = len(data) // 8, min(window, len(data) // 8)
            for k in range(n - one + 1 if n else 0):
                rows.setdefault(data[8 * k : 8 * (k + one)], set()).add(item)
        if not rows:
            return None
        keys = sorted(rows)
        lengths = np.array([len(k) // 8 for k in keys])
        flat = np.frombuffer(b"".join(keys), np.uint64)
        vocabulary = np.unique(flat)
        symbols = np.zeros((len(keys), window), np.uint32)
        symbols[np.arange(window) >= window - lengths[:, None]] = np.searchsorted(vocabulary, flat) + 1
        return Windows(vocabulary, symbols, lengths, tuple(tuple(sorted(rows[k])) for k in keys))

    def named(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that no window has."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.uint32)


def occurrences(symbols: np.ndarray, doc: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, window) of all occurrences in a shard: symbols of its words, 0 for unknown ones, and the document of each word."""
    n = len(symbols)
    known = symbols > 0
    first = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])
    last = known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin >= windows.lengths.min()
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = np.cumsum(size + 1) - size - 1
    place = np.full(int(size.sum()) + len(size), n)  # of each symbol in the shard; ends are nowhere
    at = np.arange(len(place)) - np.repeat(to, size + 1)
    inner = at < np.repeat(size, size + 1)
    place[inner] = (np.repeat(begin, size + 1) + at)[inner]
    text = np.concatenate([symbols, np.zeros(1, np.uint32)])[place]
    index = FMIndex(text)
    low, high = index.search(windows.symbols, windows.lengths)
    found = np.flatnonzero(high > low)
    many = (high - low)[found]
    rows = np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return place[index.locate(rows)], np.repeat(found, many)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of ranges that meet or overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    return start[head], end[np.concatenate([head[1:], [True]])] if len(start) else end


def _pass(n: int, windows: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n columns, text, _n_words, spans, items) with what a block of windows adds; ``n`` columns go through."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    symbols = text = 0

    def flush() -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([np.diff(first) for _, first, _ in held])
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        at, window = occurrences(np.concatenate([s for _, _, s in held]), doc, windows)
        of, start = doc[at] if len(at) else at, at - (ends - counts)[doc[at]] if len(at) else at
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            hits[int(of[rows[0]])] = (start[rows], window[rows])
        base = 0
        for part, first, _ in held:
            spans, items = part.column(n + 2).to_pylist(), part.column(n + 3).to_pylist()
            for k in range(part.num_rows):
                if base + k in hits:
                    a, win = hits[base + k]
                    old = np.array([(x["first"], x["last"] + 1) for x in spans[k]], np.int64).reshape(-1, 2)
                    a, b = merged(np.concatenate([old[:, 0], a]), np.concatenate([old[:, 1], a + windows.lengths[win]]))
                    spans[k] = [{"first": x, "last": y - 1} for x, y in zip(a.tolist(), b.tolist())]
                    items[k] = sorted({*items[k], *(i for v in np.unique(win).tolist() for i in windows.items[v])})
            base += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], pa.array(np.diff(first), pa.int64()), pa.array(spans, part.schema.field(n + 2).type), pa.array(items, pa.list_(pa.string()))], part.schema.names)

    for b in batches:
        for i, j in slices(b.column(n)):
            part = b.slice(i, j - i)
            w = words(part.column(n))
            held.append((part, w.first, windows.named(w.hash)))
            symbols, text = symbols + len(w.hash), text + len(w.bytes)
            if symbols >= SHARD or text >= SHARD_BYTES or sum(p.num_rows for p, *_ in held) >= SHARD:
                yield from flush()
                held, symbols, text = [], 0, 0
    if held:
        yield from flush()


def _pieces(size: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, n, spread, words): pieces of up to ``size`` words, the last ones of each begin the next so that no window is lost."""
    for b in batches:
        for i, j in slices(b.column(1)):
            w = words(b.column(1).slice(i, j - i))
            out = []
            for k, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                for at in range(a, max(a + 1, z - window + 1), size) if z > a else ():
                    h = w.hash[at : min(z, at + size + window - 1)]
                    out.append((b.column(0)[i + k].as_py(), len(h), int(mix(h[:window]).sum(dtype=np.uint64).astype(np.int64)), h.tobytes()))
            item, n, spread, data = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(n, pa.int64()), pa.array(spread, pa.int64()), pa.array(data, pa.binary())], ["item", "n", "spread", "words"])


def blocks(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "item_id", text_col: str = "text") -> Iterator[Windows]:
    """Windows of the benchmark, block by block, each of about ``block`` words."""
    prepare(benchmark.sparkSession)
    given = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    pieces = stash(given.mapInArrow(tidy(partial(_pieces, min(PIECE, block), window)), "item string, n long, spread long, words binary"))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = -(-int(total) // block)
    for k in range(count):
        own = Windows.of([(r.item, bytes(r.words)) for r in pieces.where(F.pmod("spread", F.lit(count)) == k).select("item", "words").toLocalIterator()], window)
        if own:
            yield own


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of docs and ADDED: _n_words, _n_hit (words inside occurrences), _spans (merged occurrences: first and last word, from 0), _items (whose windows occur)."""
    prepare(docs.sparkSession)
    plain, at = numbered(docs)
    n = len(plain.columns)
    rows = plain.withColumns({"text": F.col(at[text_col]).cast("string"), "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<first:bigint,last:bigint>>"), "items": F.array().cast("array<string>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    k = -1
    for k, windows in enumerate(blocks(benchmark, window, block, item_col, item_text)):
        rows = stash(rows) if k and k % STASHED == 0 else rows
        rows = rows.mapInArrow(tidy(partial(_pass, n, windows)), schema)
    if k < 0:
        rows = rows.mapInArrow(tidy(partial(_counted, n)), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return rows.select(*(F.col(c).alias(name) for name, c in at.items() if name not in ADDED), F.col("n_words").alias("_n_words"), hit.alias("_n_hit"), F.col("spans").alias("_spans"), F.col("items").alias("_items"))


def _counted(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts alone, for a benchmark without windows."""
    for b in batches:
        for i, j in slices(b.column(n)):
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], pa.array(words(part.column(n)).counts(), pa.int64()), *part.columns[n + 2 :]], part.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, with contaminated words gone from their texts: each span from its first word to the next word outside it. A report's ADDED stay beside them."""
    found = find_contamination(docs, benchmark, text_col, **options)
    plain, at = numbered(found)
    n, spans = len(plain.columns), list(at).index("_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(n)):
                part = b.slice(i, j - i)
                new, w = part.column(n).to_pylist(), words(part.column(n))
                for k, gone in enumerate(part.column(spans).to_pylist()):
                    if gone:
                        data, a = new[k].encode(), int(w.offsets[k])
                        keep, to = [], 0
                        for x in gone:
                            after = int(w.first[k]) + x["last"] + 1
                            keep.append(data[to : int(w.start[int(w.first[k]) + x["first"]]) - a])
                            to = int(w.start[after]) - a if after < w.first[k + 1] else len(data)
                        new[k] = b"".join([*keep, data[to:]]).decode()
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(new, pa.string())], part.schema.names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), "new string"])
    out = plain.withColumn("new", F.col(at[text_col]).cast("string")).mapInArrow(tidy(run), schema)
    return out.select(*((F.col("new") if name == text_col else F.col(c)).alias(name) for name, c in at.items()))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )
