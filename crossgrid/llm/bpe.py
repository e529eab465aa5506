"""Byte-pair encoding and decoding with an existing vocabulary of whole words.

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a
priority queue by (rank, position); an entry whose symbols have changed since it was queued is
stale and skipped. Decoding concatenates vocabulary strings.

A text's pretokens never span white space, so all work is per white-space chunk. Chunks are
remembered, up to a fixed number, and so are pretokens, as most new chunks differ from known ones in case or
punctuation alone.

Defined results: null and empty texts have no ids; white space and characters outside the
vocabulary yield none; the strings of special tokens inside a text are those tokens; texts and
words may have any length; rows are independent, so repeated rows, ties and empty tables need no rule;
extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare


#: Letters and numbers that the vocabulary's own library knows beyond those of ``unicodedata``.
LATER = {
    "L": r"\u1c89\u1c8a\ua7cb-\ua7ce\ua7d2\ua7d4\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00016ea0-\U00016eb8\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0",
    "N": r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016d70-\U00016d79\U00016130-\U00016139\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa",
}
#: Capitals that the library lowers beyond those of ``str.lower``; and no rule for a final sigma, as it lowers one character at a time.
LOWERED = str.maketrans(
    {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)


def _category(first: str) -> str:
    """Character ranges of a general category; a regex engine's own classes may be of another Unicode version than the vocabulary's library."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == first:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + LATER[first]


@functools.cache
def pretoken() -> regex.Pattern:
    """The vocabulary's pretokens, a fixed pattern: 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"""
    letter, number = _category("L"), _category("N")
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")


#: Separators that str.split() knows and the vocabulary's white space does not.
_CONTROL = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: Chunks that one worker remembers, and the longest of them.
REMEMBER, LONGEST = 250_000, 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, int], made: list[int]) -> list[int]:
    """Applies merges by rank, leftmost first among equals, until none is possible. pairs: the rank of symbols (a, b) under a << 20 | b; made: by rank the new symbol."""
    n = len(symbols)
    queue = [r << 32 | i for i in range(n - 1) if (r := pairs.get(symbols[i] << 20 | symbols[i + 1], -1)) >= 0]
    if not queue:
        return symbols
    heapq.heapify(queue)
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    while queue:
        entry = heapq.heappop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = right[i]
        if j < 0 or pairs.get(symbols[i] << 20 | symbols[j]) != rank:
            continue  # stale: a symbol is gone or has grown since
        symbols[i] = new = made[rank]
        right[i] = k = right[j]
        symbols[j] = right[j] = -1
        if k >= 0:
            left[k] = i
            if (r := pairs.get(new << 20 | symbols[k], -1)) >= 0:
                heapq.heappush(queue, r << 32 | i)
        if (h := left[i]) >= 0 and (r := pairs.get(symbols[h] << 20 | new, -1)) >= 0:
            heapq.heappush(queue, r << 32 | h)
    return [s for s in symbols if s >= 0]


class Recent(dict):
    """Results of ``make`` by key: twice ``most`` at most, of which the older half goes when the newer is full."""

    def __init__(self, make, most: int = REMEMBER, longest: int = LONGEST):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class WordBpe:
    """A vocabulary file of kind BPE with word ends: ids of chunks, and strings of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c, -1) for c in alphabet]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in alphabet]
        self.pretoken = pretoken()
        self.known = Recent(self.word)

    def word(self, word: str) -> tuple[list[int], str, str]:
        """Of a pretoken: its ids, these in decimal, and their strings."""
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        ids = merge([i for i in symbols if i >= 0] if -1 in symbols else symbols, self.pairs, self.made)
        return ids, " ".join(map(str, ids)), self.decode(ids)

    def pretokens(self, part: str) -> list[str]:
        part = unicodedata.normalize("NFC", part)
        part = (part if part.isascii() else part.translate(LOWERED)).lower()
        if part.isalpha():
            return [part]
        if part[-1:] in ".,;:!?" and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.pretoken.findall(part)

    def chunk_parts(self, chunk: str) -> list[tuple[list[int], str, str]]:
        """Of a text without white space: word() of its pretokens and special tokens."""
        if "<" not in chunk or not self.special_at:
            return [self.known[w] for w in self.pretokens(chunk)]
        out = []
        for part in self.special_at.split(chunk):
            if part in self.special:
                i = self.special[part]
                out.append(([i], str(i), self.strings[i]))
            elif part:
                out += [self.known[w] for w in self.pretokens(part)]
        return out

    def chunk(self, chunk: str) -> list[int]:
        return [i for ids, _, _ in self.chunk_parts(chunk) for i in ids]

    def chunk_digest(self, chunk: str) -> tuple[int, str, str]:
        """Of a text without white space: count of its ids, these in decimal, and their strings."""
        parts = [p for p in self.chunk_parts(chunk) if p[0]]
        return sum(len(p[0]) for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def chunks(self, text: str) -> list[str]:
        return [c for c in _WHITE.split(text) if c] if _CONTROL.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, one space between: the file names no decoder that would join them otherwise."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_OPEN: dict[str, WordBpe] = {}


def opened(path: str) -> WordBpe:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def text_digests(text: str, bpe: WordBpe, known: dict) -> tuple[int, str, str]:
    """Count of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text; hashed by pieces."""
    ids, decoded, n, chunks, lead = hashlib.sha256(), hashlib.sha256(), 0, bpe.chunks(text), False
    for at in range(0, len(chunks), 50_000):
        if rows := [r for c in chunks[at : at + 50_000] if (r := known[c])[0]]:
            counts, numbers, strings = zip(*rows)
            n += sum(counts)
            ids.update((" " * lead + " ".join(numbers)).encode())
            decoded.update((" " * lead + " ".join(strings)).encode())
            lead = True
    return n, ids.hexdigest(), decoded.hexdigest()


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the whole text; no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(tokenizer)
        known = bpe.__dict__.setdefault("digests", Recent(bpe.chunk_digest))
        for b in batches:
            rows = [text_digests(t.as_py() or "", bpe, known) for t in b.column(1)]
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"CAST({id_col} AS BIGINT) AS id", f"{text_col} AS text").mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns and, in ``out``, the text's ids as an array."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    prepare(docs.sparkSession)

    @pandas_udf("array<int>")
    def ids(texts):
        bpe = opened(tokenizer)
        return texts.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn(out, ids(F.col(text_col)))


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns and, in ``out``, the string of the ids; null ids give an empty string."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    prepare(rows.sparkSession)

    @pandas_udf("string")
    def text(ids):
        bpe = opened(tokenizer)
        return ids.map(lambda x: bpe.decode([int(i) for i in x]) if x is not None else "")

    return rows.withColumn(out, text(F.col(ids_col)))
