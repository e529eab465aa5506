"""Progressive JPEG columns: storing bytes as coefficients, and decoding to full-resolution RGB tensors.

The decoder collects all scans, by spectral selection and successive approximation, in one array of quantised
coefficients per component, transforms it back by one matrix product, doubles the chroma planes
and converts to RGB. It reads any three-component 4:2:0 or one-component progressive file of 8 bits without restarts.
Where a table has one code, or an end-of-band run covers many blocks, whole stretches are read at once.

The encoder keeps a payload without loss: a JPEG's own unit is the 8x8 block of quantised coefficients, so
64 payload bytes are one block. Byte b is the coefficient b from 128 on and -(b + 128) below: all have eight
magnitude bits, so the first AC scan holds one byte, and the refinement one bit, for each of them.

Defined results: null and empty texts are 64 zero bytes; the payload's and the text's lengths stand in a comment
segment; equal texts have equal files; a text may have any length up to the 4095 x 4095 units of an image; rows are
independent, so ties and empty tables need no rule; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, stash

BLOCK, PER_UNIT, HIGHEST = 64, 6, 4095
#: Fixed values of the file format.
SOI, EOI, SOF2, DHT, DQT, SOS, COM, DRI = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDA, 0xFE, 0xDD
_SAMPLING = ((1, 2), (2, 1), (3, 1))


def zigzag() -> np.ndarray:
    """Row-major places of coefficients in the order of anti-diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: From coefficients in zigzag order to 64 samples.
_INVERSE = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _scan_head(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(SOS, bytes([len(components), *(x for c, t in components for x in (c, t)), ss, se, ah << 4 | al]))


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of all values, each of its length, one after another."""
    end = np.cumsum(lengths)
    which = np.repeat(np.arange(len(values)), lengths)
    return (values[which] >> (end[which] - 1 - np.arange(end[-1] if len(end) else 0))) & 1


def _entropy(bits: np.ndarray) -> bytes:
    data = np.packbits(np.concatenate([bits.astype(np.uint8), np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def geometry(units: int) -> tuple[int, int]:
    """Width and height in units of 16 x 16 samples: as narrow as the format's greatest height allows."""
    wide = -(-units // HIGHEST)
    return wide, -(-units // wide)


def _in_units(wide: int, high: int) -> list[np.ndarray]:
    """Per component the blocks, in raster order, that units hold one after another."""
    y = np.arange(4 * wide * high).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(-1)
    one = np.arange(wide * high)
    return [y, one, one]


#: Tables: DC sizes 0 to 8 in four bits; the one code 0 for "no zeros, seven bits"; end-of-band runs 2^0 to 2^14 in four bits.
_DC_TABLE = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])
_AC_TABLE = bytes([0x10, 1, *[0] * 15, 0x07])
_RUN_TABLE = bytes([0x11, 0, 0, 0, 15, *[0] * 12, *(r << 4 for r in range(15))])


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    blocks = len(payload) // BLOCK
    wide, high = geometry(-(-blocks // PER_UNIT))
    units = wide * high
    data = np.zeros(units * PER_UNIT * BLOCK, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, BLOCK)
    parts = [data[: 4 * units], data[4 * units : 5 * units], data[5 * units :]]
    out = [b"\xff\xd8", _segment(COM, b"payload %d %d" % (len(payload), n_bytes)), _segment(DQT, b"\0" + b"\1" * 64)]
    out.append(_segment(SOF2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes(x for c, s in _SAMPLING for x in (c, s << 4 | s, 0))))
    out += [_segment(DHT, t) for t in (_DC_TABLE, _AC_TABLE, _RUN_TABLE)]
    order = _in_units(wide, high)
    dc = [np.where(p[:, 0] >= 128, p[:, 0].astype(np.int32), -128 - p[:, 0].astype(np.int32))[o] for p, o in zip(parts, order)]
    diffs = [np.diff(d >> 1, prepend=0) for d in dc]
    each = np.concatenate([diffs[0].reshape(units, 4), diffs[1][:, None], diffs[2][:, None]], 1).reshape(-1)
    size = np.ceil(np.log2(np.abs(each) + 1)).astype(np.int32)
    extra = np.where(each < 0, each + (1 << size) - 1, each)
    all_three = [(c, 0x00) for c, _ in _SAMPLING]
    out += [_scan_head(all_three, 0, 0, 0, 1), _entropy(pack_bits((size << size) | extra, size + 4))]
    for (c, _), p in zip(_SAMPLING, parts):
        # magnitude halved: 64 to 127 as such, or its complement in seven bits; the code before it is 0
        half = np.where(p >= 128, p >> 1, 63 - (p >> 1))
        out += [_scan_head([(c, 0x00)], 1, 63, 0, 1), half[:, 1:].tobytes()]
    low = np.concatenate([(dc[0] & 1).reshape(units, 4), (dc[1] & 1)[:, None], (dc[2] & 1)[:, None]], 1).reshape(-1)
    out += [_scan_head(all_three, 0, 0, 1, 0), _entropy(low)]
    for (c, _), p in zip(_SAMPLING, parts):
        bits = []
        for at in range(0, len(p), 32767):
            run = p[at : at + 32767, 1:] & 1
            r = len(run).bit_length() - 1
            bits += [pack_bits(np.array([r << r | (len(run) - (1 << r))]), np.array([4 + r])), run.reshape(-1)]
        out += [_scan_head([(c, 0x01)], 1, 63, 1, 0), _entropy(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


class Table:
    """A Huffman table: by the next 16 bits the code's length and symbol; length 0 where there is none."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                at = code << (16 - n)
                self.length[at : at + (1 << (16 - n))], self.symbol[at : at + (1 << (16 - n))] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


_TABLES: dict[bytes, Table] = {}


def _table(data: bytes) -> Table:
    if data not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[data] = Table(data[:16], data[16:])
    return _TABLES[data]


def _windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit position on; ones follow the end."""
    d = np.frombuffer(data + b"\xff\xff\xff", np.uint8).astype(np.int32)
    return (((d[:-2] << 16 | d[1:-1] << 8 | d[2:])[:, None] >> np.arange(8, 0, -1)) & 0xFFFF).reshape(-1)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


class Component:
    def __init__(self, h: int, v: int, q: int):
        self.h, self.v, self.q = h, v, q


class Image:
    """A parsed file: its size, comments, and coefficients (zigzag order) per component, by blocks in raster order."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comments, self.quant, self.components = [], {}, {}
        tables: dict[int, Table] = {}
        at = 2
        while True:
            marker, n = data[at + 1], 0
            if marker == EOI:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == COM:
                self.comments.append(body)
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == SOF2:
                bits, self.height, self.width, k = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("samples must have 8 bits")
                for c in range(k):
                    name, s, q = body[6 + 3 * c : 9 + 3 * c]
                    self.components[name] = Component(s >> 4, s & 15, q)
                self._allot()
            elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not a progressive file")
            elif marker == DHT:
                while body:
                    count = sum(body[1:17])
                    tables[body[0]] = _table(body[1 : 17 + count])
                    body = body[17 + count :]
            elif marker == DRI and body != b"\0\0":
                raise ValueError("restarts are not read")
            elif marker == SOS:
                end = data.find(b"\xff", at)
                while data[end + 1] == 0:
                    end = data.find(b"\xff", end + 2)
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"), tables)
                at = end

    def _allot(self) -> None:
        self.h, self.v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components.values():
            c.cols, c.rows = self.wide * c.h, self.high * c.v
            # a scan of one component leaves out blocks beyond the image
            c.own_cols, c.own_rows = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coef = np.zeros((c.rows * c.cols, 64), np.int16)

    def _blocks(self, c: Component, single: bool) -> np.ndarray | slice:
        if single:
            if (c.own_rows, c.own_cols) == (c.rows, c.cols):
                return slice(None)
            return np.arange(c.rows * c.cols).reshape(c.rows, c.cols)[: c.own_rows, : c.own_cols].reshape(-1)
        return np.arange(c.rows * c.cols).reshape(self.high, c.v, self.wide, c.h).transpose(0, 2, 1, 3).reshape(-1)

    def _scan(self, head: bytes, data: bytes, tables: dict[int, Table]) -> None:
        k = head[0]
        parts = [(self.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(k)]
        ss, se, a = head[1 + 2 * k : 4 + 2 * k]
        ah, al = a >> 4, a & 15
        if ss == 0:
            self._dc(parts, data, tables, ah, al)
            return
        c, t = parts[0]
        where = self._blocks(c, True)
        coef = c.coef if isinstance(where, slice) else c.coef[where]
        (_ac_refine if ah else _ac_first)(coef, data, tables[0x10 | t & 15], ss, se, al)
        if not isinstance(where, slice):
            c.coef[where] = coef

    def _dc(self, parts: list, data: bytes, tables: dict[int, Table], ah: int, al: int) -> None:
        orders = [self._blocks(c, len(parts) == 1) for c, _ in parts]
        orders = [np.arange(len(c.coef))[o] for (c, _), o in zip(parts, orders)]
        per = [1 if len(parts) == 1 else c.h * c.v for c, _ in parts]
        units = len(orders[0]) // per[0]
        which = np.concatenate([np.full(p, i) for i, p in enumerate(per)])
        total = units * len(which)
        if ah:
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[:total].reshape(units, -1)
            for i, ((c, _), o) in enumerate(zip(parts, orders)):
                c.coef[o, 0] |= bits[:, which == i].reshape(-1).astype(np.int16) << al
            return
        w = _windows(data)
        used = [tables[t >> 4] for _, t in parts]
        if len({id(t) for t in used}) == 1:
            step = (used[0].length + used[0].symbol)[w].tolist()
            steps = [step] * len(which)
        else:
            each = [(t.length + t.symbol)[w].tolist() for t in used]
            steps = [each[i] for i in which]
        at, p = [], 0
        for _ in range(units):
            for step in steps:
                at.append(p)
                p += step[p]
        pos = np.array(at).reshape(units, -1)
        for i, ((c, _), o, t) in enumerate(zip(parts, orders, used)):
            here = pos[:, which == i].reshape(-1)
            size = t.symbol[w[here]]
            diff = _signed(w[np.minimum(here + t.length[w[here]], len(w) - 1)] >> (16 - size), size)
            c.coef[o, 0] = np.cumsum(diff) << al

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, of the image's size in its own sampling."""
        out = []
        for c in self.components.values():
            q = self.quant[c.q]
            inverse = _INVERSE if (q == 1).all() else _INVERSE * q[:, None]
            x = c.coef.astype(np.float32) @ inverse
            x += 128.5
            np.clip(x, 0, 255.5, out=x)
            out.append(x.astype(np.uint8).reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols))
        return out

    def rgb(self) -> np.ndarray:
        """Height x width x 3 of 8 bits."""
        planes = [np.repeat(np.repeat(p, self.v // c.v, 0), self.h // c.h, 1)[: self.height, : self.width] for p, c in zip(self.planes(), self.components.values())]
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        y, cb, cr = (p.astype(np.float32) for p in planes)
        cb -= 128
        cr -= 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            x += 0.5
            np.clip(x, 0, 255.5, out=x)
            out[:, :, k] = x
        return out


def _ac_first(coef: np.ndarray, data: bytes, table: Table, ss: int, se: int, al: int) -> None:
    n, band = len(coef), se - ss + 1
    if table.only is not None and 0 < table.only < 16:
        # one code and no zeros: every coefficient has as many bits
        size = table.only
        if size == 7:
            bits = np.frombuffer(data, np.uint8, n * band).astype(np.int16)
        else:
            one = np.unpackbits(np.frombuffer(data, np.uint8))[: n * band * (size + 1)].reshape(-1, size + 1)[:, 1:]
            bits = (one.astype(np.int32) << np.arange(size - 1, -1, -1)).sum(1).astype(np.int16)
        low = bits < 1 << (size - 1)
        coef[:, ss : se + 1] = ((bits - low * np.int16((1 << size) - 1)) << al).reshape(n, band)
        return
    w = _windows(data).tolist()
    length, symbol = table.length.tolist(), table.symbol.tolist()
    p = b = 0
    while b < n:
        k = ss
        while k <= se:
            s, p = symbol[w[p]], p + length[w[p]]
            run, size = s >> 4, s & 15
            if size:
                k += run
                bits = w[p] >> (16 - size)
                p += size
                coef[b, k] = (bits if bits >> (size - 1) else bits - (1 << size) + 1) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                b += (1 << run) - 1 + (w[p] >> (16 - run) if run else 0)
                p += run
                break
        b += 1


def _ac_refine(coef: np.ndarray, data: bytes, table: Table, ss: int, se: int, al: int) -> None:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    length, symbol = table.length, table.symbol
    one = np.int16(1 << al)
    n = len(coef)

    def window(p: int) -> int:
        part = bits[p : p + 16]
        return int(np.packbits(np.concatenate([part, np.ones(16 - len(part), np.uint8)])).view(">u2")[0])

    def correct(x: np.ndarray, p: int) -> int:
        """Refines the coefficients of x that aren't zero, in order, by a bit each."""
        at = np.nonzero(x)
        old = x[at]
        more = bits[p : p + len(old)].astype(np.int16) * one
        x[at] = old + np.where(old > 0, more, -more)
        return p + len(old)

    p = b = 0
    while b < n:
        k = ss
        while k <= se:
            s = int(symbol[window(p)])
            p += int(length[window(p)])
            run, size = s >> 4, s & 15
            if not size and run < 15:
                r = 1 << run
                if run:
                    r += window(p) >> (16 - run)
                    p += run
                p = correct(coef[b, k : se + 1], p)
                if r > 1:
                    p = correct(coef[b + 1 : b + r, ss : se + 1], p)
                b += r - 1
                break
            new = 0
            if size:
                new = one if bits[p] else -one
                p += 1
            while k <= se:
                x = coef[b, k]
                if x:
                    if bits[p]:
                        coef[b, k] = x + (one if x > 0 else -one)
                    p += 1
                elif run == 0:
                    coef[b, k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        b += 1


def payload_of(image: Image) -> tuple[bytes, int]:
    """The payload that encode() has stored, and the length of the text in it."""
    n, n_bytes = map(int, next(c for c in image.comments if c.startswith(b"payload ")).split()[1:])
    x = np.concatenate([c.coef for c in image.components.values()]).reshape(-1)[:n]
    return np.where(x > 0, x, -128 - x).astype(np.uint8).tobytes(), n_bytes


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def feature(rgb: np.ndarray) -> str:
    mean = rgb.reshape(-1, 3).mean(0)
    return f"{rgb.shape[0]}x{rgb.shape[1]};{mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f};{zlib.crc32(rgb):08x}"


def store(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``media``, the texts as progressive JPEG files, written to the shared folder."""

    def encoded(text: pa.Array) -> list:
        return [pa.array([encode(padded(raw), len(raw)) for raw in ((t or "").encode() for t in text.to_pylist())], pa.binary())]

    return stash(append(docs, keep, [F.col(text_col).cast("string")], [("media", "binary", pa.binary())], encoded, 1 << 20))


def decode_rgb(rows: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns ``keep`` and height, width, rgb: row-major tensors of 8 bits; null media give nulls."""

    def decoded(media: pa.Array) -> list:
        found = [None if m is None else Image(m).rgb() for m in media.to_pylist()]
        return [pa.array([None if x is None else x.shape[0] for x in found], pa.int32()), pa.array([None if x is None else x.shape[1] for x in found], pa.int32()), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())]

    return append(rows, keep, [F.col(media_col)], [("height", "int", pa.int32()), ("width", "int", pa.int32()), ("rgb", "binary", pa.binary())], decoded, 1 << 20)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the files back, and returns their digests and a feature of each tensor."""
    fields = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]

    def read(media: pa.Array) -> list:
        out = []
        for m in media.to_pylist():
            image = Image(m)
            payload, n = payload_of(image)
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(image.rgb())))
        return list(zip(*out)) if out else [[]] * len(fields)

    rows = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    return append(rows, ["doc_id"], [F.col("media")], fields, read, 1 << 20)
