"""Language-model scores of documents: marginal probability over a subword lattice.

The pieces are those of an existing vocabulary; nothing is segmented anew. Training texts give each piece
its unigram score: words are counted over all training documents, and each distinct word's pieces
count as often as the word. A document's probability is that of its words and one end; a word's is the sum over all
segmentations into pieces, by a forward recursion in log space, with byte pieces for characters
outside the vocabulary. So each distinct word is worked out once, however often it occurs.

Blocks: texts are never exploded into word rows of documents. Each block of the input (a file split) asks for its
distinct words; counts and scores come back to the block, where its texts are scored. Words are named by
64-bit hashes in between.

Defined results: null, empty and wordless texts are one end token; a null id counts as an empty one; repeated rows are
scored, and count in training, as often as they occur; without training rows all counts are 0 and pieces are equally probable; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash, tidy, whole_groups
from .words import Words, slices

HOLD_OUT, FOLDS = 2, 7
SLICE_BYTES = 32 << 20
#: Added to the count of each piece.
PRIOR = 0.1
SPACE = "▁"


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HOLD_OUT


class Pieces:
    """The vocabulary of a piece model and, once given, the natural-log scores of its pieces and of the end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(n)]
        self.byte = {int(s[3:5], 16): i for i, s in enumerate(self.names) if self.model.is_byte(i)}
        self.whole = {s: i for i, s in enumerate(self.names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}
        self.longest = max(map(len, self.whole))
        self.end = self.model.eos_id()

    def counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """By piece the sum of weights of the words that the model's own segmentation uses it in."""
        ids = self.model.encode(words, num_threads=1)
        n = np.array([len(x) for x in ids])
        return np.bincount(np.concatenate([np.array(x, np.int64) for x in ids]) if len(ids) else [], np.repeat(weights, n), minlength=len(self.names))

    def scored(self, log: np.ndarray) -> "Pieces":
        self.log = {s: float(log[i]) for s, i in self.whole.items()}
        self.log_byte = [float(log[self.byte[b]]) for b in range(256)]
        return self

    def word(self, word: str) -> float:
        """The log of the sum over all segmentations of a word of the product of their pieces' probabilities."""
        text, log, longest = SPACE + word, self.log, self.longest
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        at = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                if not terms:
                    continue
                if len(terms) == 1:
                    at = terms[0]
                else:
                    top = max(terms)
                    at = top + math.log(sum([math.exp(t - top) for t in terms]))
                into[i] = []
            if (p := log.get(text[i])) is None:
                p = sum(self.log_byte[b] for b in text[i].encode("utf-8", "surrogatepass"))
            into[i + 1].append(at + p)
            for j in range(i + 2, min(n, i + longest) + 1):
                if (p := log.get(text[i:j])) is not None:
                    into[j].append(at + p)
        top = max(into[n])
        return top + math.log(sum(math.exp(t - top) for t in into[n]))


_OPEN: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, train, text) to the distinct words of each block: (block, hash, word, c), c: occurrences in training texts."""
    for b in batches:
        block = b.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
        for x, y in zip(edges[:-1], edges[1:]):
            for i, j in slices(b.column(2).slice(x, y - x), SLICE_BYTES):
                part = b.slice(x + i, j - i)
                w = Words(part.column(2), lower=True)
                if not len(w.start):
                    continue
                train = np.repeat(part.column(1).to_numpy(zero_copy_only=False), w.counts())
                h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                c = np.bincount(inverse[train], minlength=len(h))
                data, start, end = w.bytes.tobytes(), w.start[first].tolist(), w.end[first].tolist()
                words = pa.array([data[s:e] for s, e in zip(start, end)], pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array(np.full(len(h), block[x])), pa.array(h.astype(np.int64)), words, pa.array(c)], ["block", "hash", "word", "c"])


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = _pieces(path), 0
        for b in batches:
            total = total + pieces.counts(b.column(0).to_pylist(), b.column(1).to_numpy())
        if not np.isscalar(total):
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["piece", "n"])

    return run


def _marginals(path: str, log: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path).scored(log)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array([pieces.word(w) for w in b.column(1).to_pylist()], pa.float64())], ["hash", "c", "log_p"])

    return run


_ANSWER = np.dtype([("hash", "<u8"), ("c", "<i8"), ("log_p", "<f8")])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash, c, log_p) to blobs (block, part, data): as many words in one row as come together."""
    for b in batches:
        block = b.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        rows = np.empty(len(block), _ANSWER)
        rows["hash"] = b.column(1).to_numpy().astype(np.uint64)[order]
        rows["c"], rows["log_p"] = b.column(2).to_numpy()[order], b.column(3).to_numpy()[order]
        names, at = np.unique(block[order], return_index=True)
        yield pa.record_batch([pa.array(names), pa.array(np.zeros(len(names), np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(at, [*at[1:], len(rows)])], pa.binary())], ["block", "part", "data"])


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, held_out, text) to parcels (block, part, data) of some rows each."""
    zip_ = zstandard.ZstdCompressor(3)
    for b in batches:
        block = b.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
        for x, y in zip(edges[:-1], edges[1:]):
            for i, j in slices(b.column(3).slice(x, y - x), 1 << 20):
                part = pa.Table.from_batches([b.slice(x + i, j - i).select([1, 2, 3])]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                yield pa.record_batch([pa.array([block[x]], pa.int64()), pa.array([1], pa.int32()), pa.array([zip_.compress(sink.getvalue())], pa.binary())], ["block", "part", "data"])


def _score(total: int, distinct: int, ends: int, log_end: float):
    size = total + (distinct + 1)
    base_end = math.log10((ends + 1) / size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, table = None, [], None
        for b in batches:
            for block, part, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                if block != now:
                    now, known, table = block, [], None
                if part == 0:
                    known.append(np.frombuffer(data, _ANSWER))
                    continue
                if table is None:
                    table = np.concatenate(known) if known else np.zeros(0, _ANSWER)
                    table = table[np.argsort(table["hash"], kind="stable")]
                    name = np.ascontiguousarray(table["hash"])
                    base, log_p, seen = np.log10((table["c"] + 1) / size), table["log_p"] / math.log(10), (table["c"] > 0).astype(float)
                rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
                w = Words(rows["text"], lower=True)
                n, doc = len(rows), w.doc()
                h, inverse = np.unique(w.hash, return_inverse=True)
                at = np.searchsorted(name, h)[inverse]
                sums = [np.bincount(doc, x[at] if len(at) else None, minlength=n) for x in (base, log_p, seen)]
                yield pa.record_batch([rows["doc_id"].combine_chunks(), rows["held_out"].combine_chunks(), pa.array(w.counts() + 1), pa.array(sums[2].astype(np.int64) + (ends > 0)), pa.array(np.full(n, total)), pa.array(sums[0] + base_end), pa.array(sums[1] + log_end / math.log(10))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, piece_model: str, scanned: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. scanned: docs is read straight from files, whose splits are then the blocks; else it is written to such files first."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = (rows if scanned else stash(rows)).withColumn("block", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    asked = stash(rows.select("block", (~held_out("doc_id")).alias("train"), "text").mapInArrow(tidy(_vocabulary), "block long, hash long, word string, c long"))
    words = stash(asked.groupBy("hash", "word").agg(F.sum("c").alias("c")))
    seen = words.where("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = rows.where(~held_out("doc_id")).count()
    pieces = Pieces(piece_model)
    counts = np.full(len(pieces.names), PRIOR)
    for r in words.where("c > 0").select("word", "c").mapInArrow(tidy(_piece_counts(piece_model)), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row per piece at most
        counts[r.piece] += r.n
    counts[pieces.end] += ends
    log = np.log(counts / counts.sum())
    scored = words.select("hash", "word", "c").mapInArrow(tidy(_marginals(piece_model, log)), "hash long, c long, log_p double")
    answers = asked.select("block", "hash").join(scored, "hash").select("block", "hash", "c", "log_p").mapInArrow(tidy(_answers), "block long, part int, data binary")
    parcels = rows.select("block", "doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(tidy(_parcels), "block long, part int, data binary")
    n = max(4 * asked.select("block").distinct().count(), 4 * spark.sparkContext.defaultParallelism)  # so that few blocks share a task, whatever the input
    together = answers.unionByName(parcels).repartition(n, "block").sortWithinPartitions("block", "part")
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(tidy(_score(seen[1] + ends, seen[0] + (ends > 0), ends, float(log[pieces.end]))), fields)
