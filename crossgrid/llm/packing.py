"""Mixture-controlled packing of documents into token sequences.

Sources are queues with target shares. The whole corpus is one sequence of windows: a source that is still full
earns its share of every window, and shares of sources that have run dry go to the others in proportion. How many tokens
of each source the first x tokens hold follows from the totals by source alone, so the sequence is cut into
packs of equal size and every document knows its packs from its place in its source; packs are filled apart, yet each goes on
with the deficits at which the one before it ends. Deficit round-robin fills the windows of a pack:
a source earns its share, spends whole tokens, and carries the rest. Documents are cut where a share or a pack ends.

Places come without a shuffle: each encoding task counts the tokens of a source before a document, and totals by
task and source are summed over tasks. So no source, id or text, however frequent or long, is one task's, and all packs but the last are full.

A pack's last, short window becomes sequences of powers of two, so nothing is padded at all.

Defined results: null and empty texts are the end id alone; a null source is a source of its own, named by an
empty string; rows with one id are packed each; sources without a given target share
what the others leave by a power of their tokens; a target of 0 comes when the others are dry; a source that runs dry leaves its share to the others;
beyond QUEUES sources the smallest share a queue; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, prepare, stash, string_id, tidy, whole_groups
from .encoder import Encoder
from .words import SLICE, raw, slices

WINDOW, END_ID, PACK_TOKENS = 2048, 1, 4 << 20
#: Sources with queues of their own, and partitions of the last shuffle at most.
QUEUES, PARTITIONS = 1024, 50_000
#: Parts whose counts are summed by themselves.
STRIDE = 64
#: Pieces that leave a pack at once.
CHUNK = 1 << 18
#: Without given targets, shares go by this power of a source's tokens: below 1, small sources count more.
POWER = 0.7
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = END_ID) -> DataFrame:
    """Rows (part, source, place, doc_id, n, width, ids): the ids of each text and the end id, n of width bytes each; place: tokens of the source before it in its task's part."""
    prepare(docs.sparkSession)
    name = f"encoder {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = held(name, lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), {}
        width = encoder.kind.itemsize
        end = np.array([end_id], encoder.kind).tobytes()
        for b in batches:
            for i, j in slices(b.column(2), 2 * SLICE):
                ids, at = encoder(b.column(2).slice(i, j - i))
                data, cut = ids.tobytes(), (at * width).tolist()
                n = np.diff(at) + 1
                place = []
                for s, k in zip(b.column(1).slice(i, j - i).to_pylist(), n.tolist()):
                    place.append(before.get(s, 0))
                    before[s] = place[-1] + k
                cols = [pa.array(np.full(j - i, part, np.int64)), b.column(1).slice(i, j - i), pa.array(place, pa.int64()), b.column(0).slice(i, j - i), pa.array(n), pa.array(np.full(j - i, width, np.int32)), pa.array([data[x:y] + end for x, y in zip(cut[:-1], cut[1:])], pa.binary())]
                yield pa.record_batch(cols, ["part", "source", "place", "doc_id", "n", "width", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), string_id(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, name), "part long, source string, place long, doc_id long, n long, width int, ids binary")


class Mixture:
    """How many tokens of each source the first x tokens of all hold: min(total, weight * t), where t is such that they sum to x."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, pack: int):
        self.totals, self.pack = totals.astype(np.int64), pack
        self.weights = np.maximum(weights, weights.max(initial=0) * 1e-9)
        self.packs = max(1, math.ceil(int(self.totals.sum()) / pack))
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        full = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1][1:], [0]])
        self.t = np.concatenate([[0], dry[order]])
        self.x = np.maximum.accumulate(np.concatenate([[0], np.cumsum(self.totals[order]) + dry[order] * full]))

    def quota(self, x: float) -> np.ndarray:
        return np.minimum(self.totals, self.weights * np.interp(x, self.x, self.t))

    def low(self, q: int, pack: np.ndarray) -> np.ndarray:
        """By pack the tokens of a source before it."""
        some = np.floor(np.minimum(self.totals[q], self.weights[q] * np.interp(pack * float(self.pack), self.x, self.t))).astype(np.int64)
        return np.where(pack >= self.packs, self.totals[q], some)

    def packs_of(self, q: int, at: np.ndarray) -> np.ndarray:
        """The packs that hold these tokens of a source: a guess, put right by the packs' bounds."""
        k = np.clip(np.interp(at / self.weights[q], self.t, self.x) // self.pack, 0, self.packs - 1).astype(np.int64)
        while True:
            step = (at >= self.low(q, k + 1)).astype(np.int64) - (at < self.low(q, k))
            if not step.any():
                return k
            k = k + step


def _deal(mix: Mixture, parts: int):
    """(queue, place, doc_id, n, width, ids) to a row for each pack that a document touches: (to, pack, queue, place, doc_id, start, n, width, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            queue, place, n, width = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            first, last = np.empty(len(queue), np.int64), np.empty(len(queue), np.int64)
            for q in np.unique(queue).tolist():
                own = queue == q
                first[own], last[own] = mix.packs_of(q, place[own]), mix.packs_of(q, place[own] + n[own] - 1)
            row = np.repeat(np.arange(len(queue)), last - first + 1)
            pack = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
            start, stop = np.zeros(len(row), np.int64), n[row].astype(np.int64)
            ids = b.column(5).take(pa.array(row)) if len(row) > len(queue) else b.column(5)
            cut = np.flatnonzero((last > first)[row])
            if len(cut):
                for i in cut.tolist():
                    q, at = int(queue[row[i]]), place[row[i]]
                    low, high = mix.low(q, np.array([pack[i], pack[i] + 1])) - at
                    start[i], stop[i] = max(start[i], low), min(stop[i], high)
                keep = np.flatnonzero(stop > start)
                row, pack, start, stop = row[keep], pack[keep], start[keep], stop[keep]
                ids = pa.array([b.column(5)[int(r)].as_py()[x * w : y * w] for r, x, y, w in zip(row.tolist(), start.tolist(), stop.tolist(), width[row].tolist())], pa.binary())
            cols = [(pack * parts // mix.packs).astype(np.int32), pack, queue[row].astype(np.int32), place[row] + start]
            yield pa.record_batch([*map(pa.array, cols), b.column(2).take(pa.array(row)), pa.array(start), pa.array(n[row].astype(np.int64)), pa.array(width[row].astype(np.int32)), ids], ["to", "pack", "queue", "place", "doc_id", "start", "n", "width", "ids"])

    return run


class Queue:
    """A source's tokens of a pack, one after the other: what is left of them, from which place on, and what the source has earned."""

    def __init__(self, at: int = 0, left: int = 0, deficit: float = 0.0):
        self.at, self.left, self.deficit = at, left, deficit

    def take(self, n: int) -> int:
        self.at, self.left = self.at + n, self.left - n
        return self.at - n


def schedule(queues: list[Queue], earned: list[float], window: int) -> list[tuple[Queue, int]]:
    """How much of a window each queue fills: the whole tokens of what it has earned; room that is left, as some are dry or hold parts of tokens, goes to the others in even shares, in order of deficit. Deficits move on."""
    for q, e in zip(queues, earned):
        q.deficit += e
    order = sorted((q for q in queues if q.left), key=lambda q: -q.deficit)
    room, out = window, []
    for q in order:
        n = min(q.left, room, max(0, int(q.deficit)))
        out.append([q, n])
        room -= n
    while room:
        live = [x for x in out if x[0].left > x[1]]
        for x in live:
            n = min(room, x[0].left - x[1], max(1, room // len(live)))
            x[1] += n
            room -= n
    for q, n in out:
        q.deficit -= n
    return [(q, n) for q, n in out if n]


def fill(mix: Mixture, pack: int, queues: dict[int, Queue], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, n, sequence, offset) of the tokens that each queue gives, until all queues of a pack are dry."""
    at = float(pack) * mix.pack
    quota = mix.quota(at)
    names = list(queues)
    for k in names:
        queues[k].deficit = float(quota[k] - mix.low(k, np.array([pack]))[0])
    left = sum(q.left for q in queues.values())
    sizes = [window] * (left // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if left % window >> k & 1]
    for seq, size in enumerate(sizes):
        at += size
        now = mix.quota(at)
        offset = 0
        for q, n in schedule(list(queues.values()), (now - quota)[names].tolist(), size):
            yield q.take(n), n, seq, offset
            offset += n
        quota = now


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a pack, and the places at which rows begin and end."""
    data, at = raw(part.column(6))
    width = part.column(5).to_numpy()
    if (width == width[0]).all():
        return data.view(f"<u{width[0]}").astype("<u4"), at // int(width[0])
    pieces = [data[i:j].view(f"<u{w}").astype("<u4") for i, j, w in zip(at[:-1].tolist(), at[1:].tolist(), width.tolist())]
    return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])


def _pack(mix: Mixture, window: int):
    """Rows (pack, queue, doc_id, start, n, width, ids) in order to pieces. A pack may hold as many documents as tokens, so documents stay columns of numbers, and pieces leave CHUNK by CHUNK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, groups in whole_groups(batches):
            for i, j in zip(groups[:-1].tolist(), groups[1:].tolist()):
                part = b.slice(i, j - i)
                pack, queue, (ids, at) = part.column(0)[0].as_py(), part.column(1).to_numpy(), _tokens(part)
                heads = np.flatnonzero(np.concatenate([[True], queue[1:] != queue[:-1]]))
                ends = np.append(heads[1:], len(queue))
                queues = {int(queue[x]): Queue(int(at[x]), int(at[y] - at[x])) for x, y in zip(heads.tolist(), ends.tolist())}
                takes = np.array(list(fill(mix, pack, queues, window)), np.int64)
                takes = takes[np.argsort(takes[:, 0])]
                cuts = np.union1d(takes[:, 0], at[:-1][np.diff(at) > 0])
                size = np.diff(np.append(cuts, at[-1]))
                # in order of sequences and places
                take = np.searchsorted(takes[:, 0], cuts, "right") - 1
                offset = takes[take, 3] + cuts - takes[take, 0]
                order = np.lexsort((offset, takes[take, 2]))
                whole = memoryview(ids).cast("B")
                for low in range(0, len(order), CHUNK):
                    k = order[low : low + CHUNK]
                    begin, n, row = cuts[k], size[k], np.searchsorted(at, cuts[k], "right") - 1
                    crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + n).tolist())]
                    pick = pa.array(row)
                    start = part.column(3).take(pick).to_numpy() + begin - at[row]
                    cols = [part.column(2).take(pick), start, n, crc, part.column(4).take(pick), takes[take[k], 2] + (pack << 32), offset[k]]
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def shares(totals: dict[str | None, int], targets: dict[str, float] | None, power: float) -> dict[str | None, float]:
    """By source its share of every window: as given, or of what is left by a power of its tokens."""
    targets = targets or {}
    rest = {s: n**power for s, n in totals.items() if s not in targets}
    left = max(0.0, 1 - sum(targets.get(s, 0.0) for s in totals))
    return {s: float(targets[s]) if s in targets else left * rest[s] / sum(rest.values()) for s in totals}


def _bases(counts: DataFrame) -> DataFrame:
    """(part, source, queue, base): tokens of a row's queue before it in order of (part, source). Sums by queue and STRIDE parts come first, so that no task runs over all parts of a queue, which sources of their own may be many of."""
    counts = counts.withColumn("block", F.floor(F.col("part") / STRIDE))
    before = counts.groupBy("queue", "block").agg(F.sum("n").alias("sum"))
    before = before.select(F.col("queue").alias("_queue"), F.col("block").alias("_block"), (F.sum("sum").over(Window.partitionBy("queue").orderBy("block")) - F.col("sum")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("queue", "block").orderBy("part", "source")) - F.col("n")
    rows = counts.withColumn("inner", inner)
    return rows.join(before, (F.col("queue") == F.col("_queue")) & (F.col("block") == F.col("_block"))).select("part", "source", "queue", (F.col("before") + F.col("inner")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, power: float = POWER, window: int = WINDOW, pack_tokens: int = PACK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece. targets: shares by source of each window; sources without one share the rest by this power of their tokens (1: as they are)."""
    if window & (window - 1) or pack_tokens % window:
        raise ValueError("the window must be a power of two, and a pack some windows")
    spark = docs.sparkSession
    rows = stash(tokens(docs, tokenizer, id_col, text_col, source_col))
    by = rows.groupBy("part", "source").agg(F.max(F.col("place") + F.col("n")).alias("n"))
    total, count = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("source")).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    totals = {r.source: r.n for r in by.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES - 1).collect()}  # the largest; all others are one queue
    names = list(totals)
    if count > len(names):
        totals[None] = total - sum(totals.values())
    weights = shares(totals, targets, power)
    mix = Mixture(np.array([*totals.values()]), np.array([*weights.values()]), pack_tokens)
    queues = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "source string, queue int")
    bases = by.join(queues, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    # a row per task and source; as a table, its size is known before the join is planned: small, it is broadcast and ids stay in place
    bases = stash(_bases(stash(bases)))
    parts = min(mix.packs, PARTITIONS)
    placed = rows.join(bases, ["part", "source"]).select("queue", (F.col("base") + F.col("place")).alias("place"), "doc_id", "n", "width", "ids")
    dealt = placed.mapInArrow(tidy(_deal(mix, parts)), "to int, pack long, queue int, place long, doc_id long, start long, n long, width int, ids binary")
    dealt = dealt.repartitionById(parts, F.col("to")).sortWithinPartitions("pack", "queue", "place").select("pack", "queue", "doc_id", "start", "n", "width", "ids")
    return dealt.mapInArrow(tidy(_pack(mix, window)), SCHEMA)
