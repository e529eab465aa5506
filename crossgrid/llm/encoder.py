"""Ids of whole texts by an existing tokenizer file, worked out once per distinct pretoken.

Where the file lower-cases, drops white space and splits letters, digits and marks apart, plain texts are cut into such
pretokens by arrays over their bytes; chunks between white space that hold anything less plain (apostrophes, ``<``, letters beyond
the Latin blocks, controls) stay whole. A slice of texts asks for its distinct pretokens only, a worker remembers the
latest of them, and what it doesn't goes to the library together: plain pretokens as one text, each of which
ends at the next id that ends a word. The ids of all pretokens are then gathered at once.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .words import _LOWER, Words, raw

#: Pretokens that a worker remembers (twice as many at most), and the longest of them in bytes.
REMEMBER, LONGEST = 250_000, 48
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)

#: Kinds of bytes: 0xC3 to 0xC9 lead the Latin letters up to U+024F, but for three characters.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[ord("'"), ord("<")]] = _ODD
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = _LETTER
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_NOT_LETTERS = ("×".encode(), "÷".encode(), "İ".encode())  # the last has two characters in lower case


class Pretokens(Words):
    """Like Words, but for plain chunks their runs of letters, single digits and runs of marks; ``odd`` tells the chunks that stay whole."""

    def __init__(self, column: pa.Array):
        self.bytes, self.offsets = raw(column)
        n = len(self.bytes)
        kind = _KIND[self.bytes]
        for a, b in _NOT_LETTERS:
            kind[:-1][(self.bytes[:-1] == a) & (self.bytes[1:] == b)] = _ODD
        full = kind != _SPACE
        edge = np.zeros(n + 1, bool)  # before a byte: a text begins
        edge[self.offsets] = True
        chunk = full.copy()
        chunk[1:] &= ~full[:-1] | edge[1:-1]
        number = np.cumsum(chunk, dtype=np.int32) - 1
        whole = np.zeros(int(number[-1]) + 1 if n else 0, bool)
        whole[number[kind == _ODD]] = True
        odd = whole[number] & full if len(whole) else full
        begins = kind == _DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins = chunk | begins & full & ~odd
        ends = full.copy()
        ends[:-1] &= ~full[1:] | begins[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.odd = odd[self.start]
        self.bytes = np.where(odd, self.bytes, _LOWER[self.bytes])
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes()


class Memory:
    """Results by key: the older half goes when the newer is full."""

    def __init__(self, most: int = REMEMBER, longest: int = LONGEST):
        self.most, self.longest, self.now, self.old = most, longest, {}, {}

    def get(self, keys: list, make) -> list:
        """The results of distinct keys; those not remembered come from make(new keys)."""
        if len(self.now) + len(keys) > self.most:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        out = [now.get(k) for k in keys]
        new = []
        for i, v in enumerate(out):
            if v is None:
                if (v := old.get(keys[i])) is None:
                    new.append(i)
                else:
                    out[i] = now[keys[i]] = v
        if new:
            for i, v in zip(new, make([keys[i] for i in new])):
                out[i] = v
                if len(keys[i]) <= self.longest:
                    now[keys[i]] = v
        return out


class Encoder:
    """Ids of texts as little-endian 16- or 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        n = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.plain, self.odd = Memory(), Memory(REMEMBER // 4)
        self.cuts = splits(path)
        self.final = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def _alone(self, keys: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)]

    def _together(self, keys: list[bytes]) -> list[bytes]:
        ids = np.array(self.library.encode_batch_fast([b" ".join(keys).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.final[ids]) + 1) * self.kind.itemsize).tolist()
        if len(ends) != len(keys):
            return self._alone(keys)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and len + 1 positions at which those of each text begin."""
        if not self.cuts:
            found = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.cumsum([0, *map(len, found)])
        w = Pretokens(texts)
        _, first, inverse = np.unique(w.hash ^ w.odd.astype(np.uint64), return_index=True, return_inverse=True)
        data, odd = w.bytes.tobytes(), w.odd[first]
        keys = [data[i:j] for i, j in zip(w.start[first].tolist(), w.end[first].tolist())]
        found: list[bytes] = [b""] * len(keys)
        for memory, make, some in ((self.plain, self._together, ~odd), (self.odd, self._alone, odd)):
            at = np.flatnonzero(some).tolist()
            for i, v in zip(at, memory.get([keys[i] for i in at], make)):
                found[i] = v
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(found), self.kind)
        lengths = size[inverse]
        at = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begin[inverse] - at[:-1], lengths) + np.arange(at[-1])] if len(pool) else pool
        return ids, at[w.first]


def splits(path: str) -> bool:
    """Whether the file treats texts as Pretokens needs it: lower case, white space dropped, letters, digits and marks apart."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    patterns = [p.get("pattern", {}).get("Regex", "") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and any(p.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for p in patterns)
