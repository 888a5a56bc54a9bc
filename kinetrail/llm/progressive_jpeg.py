"""Progressive JPEG media columns: a numpy decoder, and lossless payloads in coefficients.

``decode_many`` accumulates spectral-selection and successive-approximation
scans into coefficient arrays, inverse-transforms them, repeats chroma to full
resolution and gives RGB tensors.  Entropy decoding runs all restart intervals
of all images with equal tables and scan scripts in step, one numpy operation
a symbol.  The transform uses whole-number bases in doubles, exact in any
order of summation, so that equal images give equal tensors everywhere.

``encode_payloads`` stores bytes losslessly in the format's own unit, the
quantised coefficient: the commoner a byte is in text, the smaller its
coefficient (the filling byte is zero), in zigzag order, in 4:2:0 units of four
luma and two chroma blocks.  Nine scans: two spectral bands of luma, and every
coefficient's last bit in a refinement, so that zero runs, ends of bands over
several blocks and newly significant coefficients all occur.

``store_texts`` writes the files to a table in shared storage, ``decode_media``
reads them from there and gives payloads and RGB tensors as columns.

Defined cases: null text is empty (a payload of 576 bytes of 255); rows that
repeat an id or a text are stored each, equal texts equally; nothing is
ordered, so there are no ties; very long texts become images of many rows; an
empty table gives no rows; a file that is no progressive 8-bit JPEG, or is
damaged, raises in ``decode_many`` and is null in ``tensors`` and
``decode_media``; other columns are ignored.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import sliced, stored

UNIT = 576
_MCU = 384
#: Units or blocks between restart markers: what is decoded side by side.
RESTART = 8
_SLICE_BYTES = 4_000_000
_TAG = b"payload:"


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural position of each zigzag index, from the walk along antidiagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(1)
def _basis() -> np.ndarray:
    """(zigzag coefficient, pixel) of the inverse transform, times 2^16, whole numbers."""
    x = np.arange(8)
    a = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)
    return np.round(full * 65536)[zigzag()]


# ---- entropy coding of stored payloads


def _codes(lengths: list[int]) -> list[int]:
    """Canonical codes of symbols sorted by length."""
    out, code, last = [], 0, lengths[0]
    for n in lengths:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    return out


def _table(kind: int, symbols: list[int], lengths: list[int]) -> bytes:
    body = bytes([kind]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _shares(kind: str) -> dict[int, float]:
    """How often a table's symbols are expected in text: runs get rarer by a factor, sizes by a share each."""
    if kind == "dc":
        return dict(enumerate((3, 5, 9, 12, 10, 8, 6, 5, 3)))
    ends = {n << 4: 2.0 / (1 + 4 * n) for n in range(15)}
    if kind == "refine":
        return ends | {r << 4 | 1: 30 * 0.1**r for r in range(16)} | {0xF0: 1e-3}
    sizes = (28, 34, 26, 7, 2.5, 0.6, 1.5)
    return ends | {r << 4 | n + 1: w * 0.33**r for r in range(16) for n, w in enumerate(sizes)} | {0xF0: 1e-3}


@lru_cache(3)
def _huffman(kind: str) -> tuple[list[int], list[int]]:
    """(symbols, code lengths) of a prefix code for the expected shares, at most 16 bits; no code is all ones."""
    share = _shares(kind)
    least = sum(share.values()) / 2**11
    heap = [(max(w, least), i, (i,)) for i, w in enumerate([*share.values(), 0.0])]  # the last takes the code of ones
    depth = [0] * len(heap)
    heapify(heap)
    while len(heap) > 1:
        (w, i, x), (v, j, y) = heappop(heap), heappop(heap)
        for k in (*x, *y):
            depth[k] += 1
        heappush(heap, (w + v, min(i, j), (*x, *y)))
    depth[-1] = 99
    order = sorted(range(len(depth) - 1), key=lambda k: (depth[k], k))
    longest = max(depth[:-1])
    codes = _codes([depth[k] for k in order])
    if codes[-1] == (1 << longest) - 1 or longest > 16:
        raise AssertionError("no valid code")
    symbols = list(share)
    return [symbols[k] for k in order], [depth[k] for k in order]


@lru_cache(3)
def _lookup(kind: str) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, "i8"), np.zeros(256, "i8")
    symbols, lengths = _huffman(kind)
    code[symbols], size[symbols] = _codes(lengths), lengths
    return code, size


#: Fixed value of the stored form: bytes from the commonest on; the others follow in ascending order.
_COMMON = b"\xff etnairsodlhucm\xc3gpbfvwzkyqjx.,\n"


@lru_cache(1)
def coefficient_of_byte() -> np.ndarray:
    """0, 1, -1, 2, -2, ... in the order of frequency."""
    order = [*_COMMON, *(b for b in range(256) if b not in _COMMON)]
    out = np.empty(256, "i8")
    rank = np.arange(256)
    out[order] = np.where(rank % 2, (rank + 1) // 2, -(rank // 2))
    return out


@lru_cache(1)
def _byte_of_coefficient() -> np.ndarray:
    out = np.zeros(257, "u1")
    out[coefficient_of_byte() + 128] = np.arange(256)
    return out


def _magnitude(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype("f8"))[1].astype("i8")


def _bits_of(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A value's extra bits."""
    return np.where(v < 0, v + (1 << size) - 1, v)


def _pack(codes: np.ndarray, sizes: np.ndarray, lane: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes a lane) of codes in the order of their lanes, each lane's last byte filled with ones."""
    bits = np.bincount(lane, sizes, n_lanes).astype("i8")
    n = (bits + 7) >> 3
    start = np.cumsum(n) - n
    at = np.cumsum(sizes) - sizes + (8 * start - (np.cumsum(bits) - bits))[lane]
    total = int(n.sum())
    value, word, most = codes.astype("u8") << (64 - (at & 31) - sizes).astype("u8"), at >> 5, (total >> 2) + 3
    words = np.bincount(word, value >> np.uint64(32), most)[:most].astype("u4")
    over = np.flatnonzero(value & np.uint64(0xFFFFFFFF))
    words += np.bincount(word[over] + 1, value[over] & np.uint64(0xFFFFFFFF), most)[:most].astype("u4")
    out = words.astype(">u4").view("u1")[:total].copy()
    out[start + n - 1] |= ((1 << (8 * n - bits)) - 1).astype("u1")
    return out, n


def _band_ends(open_: np.ndarray, empty: np.ndarray, lane: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, code, size) of the ends of bands: one for a block and the empty ones that follow it in its lane."""
    follows = np.zeros(len(lane), bool)
    follows[1:] = open_[:-1] & (lane[1:] == lane[:-1]) & empty[1:]
    begins = open_ & ~follows
    run = np.bincount(np.cumsum(begins)[open_] - 1)
    n = np.frexp(run.astype("f8"))[1].astype("i8") - 1
    code, length = _lookup(kind)
    return np.flatnonzero(begins), code[n << 4] << n | (run - (1 << n)), length[n << 4] + n


def _first_codes(part: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, size, lane) of a band's first scan."""
    block, k = np.nonzero(part)
    v = part[block, k]
    before = np.concatenate([[-1], k[:-1]])
    before[np.flatnonzero(np.diff(block, prepend=-1))] = -1
    run, size = k - before - 1, _magnitude(v)
    code, length = _lookup("first")
    symbol = (run & 15) << 4 | size
    codes, sizes = code[symbol] << size | _bits_of(v, size), length[symbol] + size
    if (long := run >> 4).any():
        last = np.cumsum(long + 1) - 1
        block, codes, sizes = (np.repeat(x, long + 1) for x in (block, codes, sizes))
        rest = np.ones(len(block), bool)
        rest[last] = False
        codes[rest], sizes[rest] = code[0xF0], length[0xF0]
    count = np.bincount(block, minlength=len(part))
    at, end, end_size = _band_ends(part[:, -1] == 0, count == 0, lane, "first")
    place = np.cumsum(count)[at]
    return np.insert(codes, place, end), np.insert(sizes, place, end_size), lane[np.insert(block, place, at)]


def _refinement_codes(part: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, size, lane) of a band's scan of the last bit: a symbol for each new coefficient, then the old ones' bits up to it."""
    size_ = np.abs(part)
    width = part.shape[1]
    old, new, zero = size_ > 1, size_ == 1, size_ == 0
    has = new.any(1)
    last = np.where(has, width - 1 - new[:, ::-1].argmax(1), -1)
    stops, since = new.copy(), np.zeros(part.shape, "i1")  # zeros behind the last new coefficient
    some = np.flatnonzero(zero.any(1))
    zeros = np.cumsum(zero[some], 1, dtype="i1")
    since[some] = zeros
    since[some, 1:] -= np.maximum.accumulate(np.where(new[some], zeros, 0), 1)[:, :-1]
    stops[some] |= zero[some] & (since[some] > 0) & (since[some] % 16 == 0) & (np.arange(width) < last[some, None])  # sixteen zeros are a symbol of their own
    segment = np.cumsum(stops, 1, dtype="i1") - stops
    code, length = _lookup("refine")
    block, k = np.nonzero(stops)
    fresh = new[block, k]
    symbol = np.where(fresh, (since[block, k].astype("i8") & 15) << 4 | 1, 0xF0)
    codes = np.where(fresh, code[symbol] << 1 | (part[block, k] > 0), code[symbol])
    at, end, end_size = _band_ends(last < width - 1, ~has, lane, "refine")
    old_block, old_k = np.nonzero(old)
    keys = np.concatenate([(block * 64 + segment[block, k]) * 2, (at * 64 + stops.sum(1)[at]) * 2, (old_block * 64 + segment[old_block, old_k]) * 2 + 1])
    order = np.argsort(keys, kind="stable")
    every = np.concatenate([codes, end, size_[old_block, old_k] & 1])[order]
    sizes = np.concatenate([length[symbol] + fresh, end_size, np.ones(len(old_block), "i8")])[order]
    return every, sizes, lane[np.concatenate([block, at, old_block])[order]]


def _intervals(flat: np.ndarray, sizes: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Each image's scan data: stuffed, with restart markers between its lanes."""
    full = flat == 255
    lane = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) + np.cumsum(full) - full + 2 * lane
    ends = np.cumsum(sizes) - 1
    mark = at[ends] + 1 + full[ends]
    out = np.zeros(int(mark[-1]) + 2, "u1")
    out[at] = flat
    first = np.cumsum(lanes) - lanes
    out[mark], out[mark + 1] = 255, 0xD0 + (np.arange(len(sizes)) - np.repeat(first, lanes)) % 8
    begins = at[(np.cumsum(sizes) - sizes)[first]].tolist()
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(begins, mark[first + lanes - 1].tolist())]


@lru_cache(4096)
def _luma_raster(rows: int, cols: int) -> np.ndarray:
    return np.arange(rows * cols * 4).reshape(rows, cols, 2, 2).transpose(0, 2, 1, 3).ravel()


def _grid(n_bytes: int) -> tuple[int, int]:
    units = -(-n_bytes // _MCU)
    return (1, units) if units <= 4095 else (-(-units // 1024), 1024)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each non-empty payload."""
    if not payloads:
        return []
    grids = [_grid(len(p)) for p in payloads]
    units = np.array([r * c for r, c in grids])
    raw = np.frombuffer(b"".join(p + b"\xff" * (int(n) * _MCU - len(p)) for p, n in zip(payloads, units)), "u1")
    v = coefficient_of_byte()[raw].reshape(-1, 6, 64)
    first = np.cumsum(units) - units
    raster = np.concatenate([_luma_raster(*g) + 4 * f for g, f in zip(grids, first.tolist())])
    planes = [v[:, :4].reshape(-1, 64)[raster], v[:, 4], v[:, 5]]

    def lanes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Restart intervals of each image, and each block's (or unit's) interval."""
        n = -(-counts // RESTART)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return n, within // RESTART + np.repeat(np.cumsum(n) - n, counts)

    by_unit, by_luma = lanes_of(units), lanes_of(4 * units)

    def scan(lanes: tuple[np.ndarray, np.ndarray], codes: np.ndarray, sizes: np.ndarray, lane: np.ndarray) -> list[bytes]:
        return _intervals(*_pack(codes, sizes, lane, int(lanes[0].sum())), lanes[0])

    high, (count, lane) = v[:, :, 0] >> 1, by_unit
    diff = high.copy()
    diff[:, 1:4] -= high[:, :3]
    inside = np.flatnonzero(lane[1:] == lane[:-1]) + 1  # units with one before them in their interval
    diff[inside, 0] -= high[inside - 1, 3]
    diff[inside, 4:] -= high[inside - 1, 4:]
    diff, each = diff.ravel(), np.repeat(lane, 6)
    size, (code, length) = _magnitude(diff), _lookup("dc")
    together = b"\x03\x01\x00\x02\x00\x03\x00\x00\x00"
    scans = [(together + b"\x01", scan(by_unit, code[size] << size | _bits_of(diff, size), length[size] + size, each))]
    scans.append((together + b"\x10", scan(by_unit, v[:, :, 0].ravel() & 1, np.ones(len(each), "i8"), each)))
    for c, a, b in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        part, lanes = planes[c][:, a : b + 1], (by_unit if c else by_luma)
        scans.append((bytes([1, c + 1, 0, a, b, 0x01]), scan(lanes, *_first_codes(np.sign(part) * (np.abs(part) >> 1), lanes[1]))))
    for c in range(3):
        lanes = by_unit if c else by_luma
        scans.append((bytes([1, c + 1, 1, 1, 63, 0x10]), scan(lanes, *_refinement_codes(planes[c][:, 1:], lanes[1]))))

    tables = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
    huffman = _table(0x00, *_huffman("dc")) + _table(0x10, *_huffman("first")) + _table(0x11, *_huffman("refine")) + b"\xff\xdd\x00\x04" + struct.pack(">H", RESTART)
    out = []
    for i, (p, (rows, cols)) in enumerate(zip(payloads, grids)):
        note = _TAG + b"%d" % len(p)
        frame = struct.pack(">HBHHB", 17, 8, 16 * rows, 16 * cols, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        parts = [b"\xff\xd8\xff\xfe", struct.pack(">H", len(note) + 2), note, tables, b"\xff\xc2", frame, huffman]
        for head, data in scans:
            parts += b"\xff\xda", struct.pack(">H", len(head) + 2), head, data[i]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---- decoding


@dataclass
class Scan:
    parts: tuple  # (component, DC table, AC table)
    start: int
    end: int
    high: int
    low: int
    interval: int
    data: bytes


@dataclass
class Picture:
    """A parsed file: everything but the entropy-coded bits is interpreted."""

    width: int = 0
    height: int = 0
    components: tuple = ()  # (id, h, v, quantisation table)
    quantisers: dict = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    notes: list[bytes] = field(default_factory=list)

    def script(self):
        """What pictures decoded in step have in common."""
        return self.components, tuple((s.parts, s.start, s.end, s.high, s.low, s.interval) for s in self.scans), tuple(sorted(self.quantisers.items()))


def parse(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    buf = np.frombuffer(data, "u1")
    at = np.flatnonzero(buf[:-1] == 255)
    after = buf[at + 1]
    stops = at[(after != 0) & (after != 255) & ((after & 0xF8) != 0xD0)].tolist()
    out, huffman, interval, i, stop = Picture(), {}, 0, 2, 0
    while i + 4 <= len(data):
        if data[i] != 255:
            raise ValueError("a marker is missing")
        mark = data[i + 1]
        if mark == 255:
            i += 1
            continue
        if mark == 0xD9:
            break
        n = data[i + 2] << 8 | data[i + 3]
        body, i = data[i + 4 : i + 2 + n], i + 2 + n
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                out.quantisers[k] = struct.unpack(f">64{'H' if wide else 'B'}", body[1 : 65 + 64 * wide])
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif mark == 0xC2:
            depth, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not out.height or not out.width:
                raise ValueError("only 8-bit grey or colour frames of known size")
            out.components = tuple((body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n))
        elif 0xC0 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not a progressive JPEG file")
        elif mark == 0xDD:
            interval = body[0] << 8 | body[1]
        elif mark == 0xFE:
            out.notes.append(body)
        elif mark == 0xDA:
            names = {c[0]: k for k, c in enumerate(out.components)}
            n = body[0]
            start, end, steps = body[1 + 2 * n : 4 + 2 * n]
            parts = tuple((names[body[1 + 2 * c]], huffman.get(body[2 + 2 * c] >> 4) if not start else None, huffman.get(0x10 | body[2 + 2 * c] & 15) if start else None) for c in range(n))
            if start > end or end > 63 or start and n > 1 or not start and end:
                raise ValueError("a scan's band is not progressive")
            while stop < len(stops) and stops[stop] < i:
                stop += 1
            close = stops[stop] if stop < len(stops) else len(data)
            out.scans.append(Scan(parts, start, end, steps >> 4, steps & 15, interval, data[i:close]))
            i = close
    if not out.components or not out.scans:
        raise ValueError("no frame or no scan")
    return out


@lru_cache(64)
def _decoder(table: bytes | None) -> np.ndarray:
    """(length << 8 | symbol) of each 16-bit window; 0 where no code begins."""
    if table is None:
        raise ValueError("a Huffman table is missing")
    out, code, at = np.zeros(65536, "i8"), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """Lanes of bits: 40-bit windows at every byte."""

    def __init__(self, clean: np.ndarray, starts: np.ndarray):
        c = np.concatenate([clean, np.zeros(64, "u1")]).astype("i8")
        self.window = (c[:-4] << 32) | (c[1:-3] << 24) | (c[2:-2] << 16) | (c[3:-1] << 8) | c[4:]
        self.bytes, self.most = c, 8 * (len(clean) + 8)
        self.pos = starts.astype("i8") * 8

    def look(self, p):
        if len(p) and p.max() > self.most:
            raise ValueError("a scan ends early")
        return self.window[p >> 3], p & 7

    def one(self, p):
        return (self.bytes[p >> 3] >> (7 - (p & 7))) & 1


def _lanes(datas: list[bytes]) -> tuple[_Bits, np.ndarray, np.ndarray]:
    """Unstuffed bits, and each restart interval's image and place in it."""
    raw = np.frombuffer(b"".join(datas) + b"\x00", "u1")
    sizes = np.array([len(d) for d in datas])
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    restart = full[(after & 0xF8) == 0xD0]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    keep[full[after == 255]] = False
    keep[restart] = keep[restart + 1] = False
    keep[-1] = False
    to = np.concatenate([[0], np.cumsum(keep)])
    first = np.cumsum(sizes) - sizes
    begins = np.concatenate([first, restart + 2])
    order = np.argsort(begins, kind="stable")
    image = np.concatenate([np.arange(len(datas)), np.searchsorted(first, restart, "right") - 1])[order]
    heads = np.flatnonzero(np.diff(image, prepend=-1))
    place = np.arange(len(image)) - np.repeat(heads, np.diff(np.append(heads, len(image))))
    return _Bits(raw[keep], to[begins[order]]), image, place


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)


@dataclass
class _Layout:
    """Block grids of one component over the group's images."""

    offset: np.ndarray
    padded: np.ndarray  # blocks a row, with those that fill the last unit
    used: np.ndarray  # blocks a row and rows in a scan of this component alone
    used_rows: np.ndarray
    h: int
    v: int


def decode_many(files: list[bytes]) -> list[tuple[np.ndarray, list[np.ndarray], Picture]]:
    """(RGB tensor, coefficients of each component in zigzag order and raster of blocks, parsed file) of each file."""
    pictures = [parse(f) for f in files]
    groups: dict = {}
    for i, p in enumerate(pictures):
        groups.setdefault(p.script(), []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, found in zip(members, _decode_group([pictures[i] for i in members])):
            out[i] = found
    return out


def _decode_group(pictures: list[Picture]):
    kind = pictures[0].components
    hm, vm = max(c[1] for c in kind), max(c[2] for c in kind)
    w, h = np.array([p.width for p in pictures]), np.array([p.height for p in pictures])
    mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
    layouts, arrays = [], []
    for _, ch, cv, _ in kind:
        n = mw * ch * mh * cv
        layouts.append(_Layout(np.cumsum(n) - n, mw * ch, -(-(-(-w * ch // hm)) // 8), -(-(-(-h * cv // vm)) // 8), ch, cv))
        arrays.append(np.zeros((int(n.sum()), 64), "i4"))
    for k, scan in enumerate(pictures[0].scans):
        _decode_scan(scan, [p.scans[k].data for p in pictures], layouts, arrays, mw, mh)
    pixels = []
    for (_, _, _, q), coefficients in zip(kind, arrays):
        exact = coefficients * np.array(pictures[0].quantisers[q])
        pixels.append(np.clip(np.floor(exact.astype("f8") @ _basis() / 65536 + 128.5), 0, 255).astype("u1"))
    for i, p in enumerate(pictures):
        planes, blocks = [], []
        for lay, a, px in zip(layouts, arrays, pixels):
            rows, cols = int(mh[i]) * lay.v, int(mw[i]) * lay.h
            part = slice(int(lay.offset[i]), int(lay.offset[i]) + rows * cols)
            blocks.append(a[part])
            plane = px[part].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
            if lay.v < vm:
                plane = np.repeat(plane, vm // lay.v, 0)
            if lay.h < hm:
                plane = np.repeat(plane, hm // lay.h, 1)
            planes.append(plane[: p.height, : p.width])
        yield _rgb(planes), blocks, p


def _rgb(planes: list[np.ndarray]) -> np.ndarray:
    """Full-range YCbCr to RGB in 16-bit fixed point."""
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = (x.astype("i4") for x in planes)
    y, cb, cr = (y << 16) + 32768, cb - 128, cr - 128
    out = np.empty((*y.shape, 3), "u1")
    out[..., 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
    return out


def _decode_scan(scan: Scan, datas, layouts, arrays, mw, mh) -> None:
    bits, image, place = _lanes(datas)
    alone = len(scan.parts) == 1
    lay = layouts[scan.parts[0][0]]
    total = (lay.used * lay.used_rows if alone else mw * mh)[image]
    each = np.full(len(image), scan.interval) if scan.interval else total
    begin = place * each
    count = np.clip(total - begin, 0, each)
    if (np.bincount(image, count, len(datas)) != np.bincount(image, total * (place == 0), len(datas))).any():
        raise ValueError("restart intervals are missing")
    if alone:
        c, dc, ac = scan.parts[0]
        state = np.zeros(len(image), "i8")
        for j in range(int(count.max(initial=0))):
            lanes = np.flatnonzero(count > j)
            unit = begin[lanes] + j
            of = image[lanes]
            block = lay.offset[of] + unit // lay.used[of] * lay.padded[of] + unit % lay.used[of]
            if not scan.start:
                _dc(scan, bits, lanes, block, arrays[c], state, dc)
            elif scan.high:
                _ac_refine(scan, bits, lanes, block, arrays[c], state, _decoder(ac))
            else:
                _ac_first(scan, bits, lanes, block, arrays[c], state, _decoder(ac))
        return
    states = [np.zeros(len(image), "i8") for _ in scan.parts]
    for j in range(int(count.max(initial=0))):
        lanes = np.flatnonzero(count > j)
        unit, of = begin[lanes] + j, image[lanes]
        row, col = unit // mw[of], unit % mw[of]
        for (c, dc, _), state in zip(scan.parts, states):
            lay = layouts[c]
            for v in range(lay.v):
                for h in range(lay.h):
                    _dc(scan, bits, lanes, lay.offset[of] + (row * lay.v + v) * lay.padded[of] + col * lay.h + h, arrays[c], state, dc)


def _dc(scan, bits, lanes, block, coefficients, state, table) -> None:
    p = bits.pos[lanes]
    if scan.high:
        bits.look(p)
        coefficients[block, 0] |= (bits.one(p) << scan.low).astype("i4")
        bits.pos[lanes] = p + 1
        return
    window, f = bits.look(p)
    found = _decoder(table)[(window >> (24 - f)) & 0xFFFF]
    n, s = found >> 8, found & 255
    if not n.all() or s.max(initial=0) > 15:
        raise ValueError("no such DC code")
    state[lanes] += _extend((window >> (40 - f - n - s)) & ((1 << s) - 1), s)
    coefficients[block, 0] = state[lanes] << scan.low
    bits.pos[lanes] = p + n + s


def _ac_first(scan, bits, lanes, block, coefficients, runs, table) -> None:
    waiting = runs[lanes] > 0
    if waiting.any():
        runs[lanes[waiting]] -= 1
        lanes, block = lanes[~waiting], block[~waiting]
    flat, p, at = coefficients.reshape(-1), bits.pos[lanes], block * 64 + scan.start
    last = block * 64 + scan.end
    while len(p):
        window, f = bits.look(p)
        found = table[(window >> (24 - f)) & 0xFFFF]
        n, s = found >> 8, found & 15
        if not n.all():
            raise ValueError("no such AC code")
        if s.all() and not (found & 0xF0).any():  # values without zeros between, the common case here
            flat[at] = _extend((window >> (40 - f - n - s)) & ((1 << s) - 1), s) << scan.low
            p, at = p + n + s, at + 1
            done = at > last
        else:
            r, value = (found >> 4) & 15, s > 0
            end = ~value & (r < 15)
            more = np.where(value, s, np.where(end, r, 0))
            v = (window >> (40 - f - n - more)) & ((1 << more) - 1)
            p = p + n + more
            at = at + np.where(value, r, np.where(end, 0, 16))
            if (value & (at > last)).any():
                raise ValueError("a run leaves its band")
            flat[at[value]] = _extend(v, s)[value] << scan.low
            runs[lanes[end]] = ((1 << r) - 1 + v)[end]
            at = at + value
            done = end | (at > last)
        if done.any():
            bits.pos[lanes[done]] = p[done]
            stay = ~done
            p, at, last, lanes = p[stay], at[stay], last[stay], lanes[stay]


def _ac_refine(scan, bits, lanes, block, coefficients, runs, table) -> None:
    """Symbols step from zero to zero among the band's zeros; where the old coefficients' bits lie is noted and read at the end."""
    a, width, step = scan.start, scan.end - scan.start + 1, 1 << scan.low
    rows = coefficients[block, a : scan.end + 1]
    old = rows != 0
    behind = np.zeros((len(rows), width + 1), "i2")  # old coefficients before each place
    np.cumsum(old, 1, dtype="i2", out=behind[:, 1:])
    n_old = behind[:, -1].astype("i8")
    n_zeros = width - n_old
    zero_at, first_zero = np.nonzero(~old)[1], np.cumsum(n_zeros) - n_zeros
    old_row, old_at = np.nonzero(old)
    first_old = np.cumsum(n_old) - n_old
    zero_at = np.append(zero_at, 0)
    row, p, k, z = np.arange(len(lanes)), bits.pos[lanes], np.zeros(len(lanes), "i8"), np.zeros(len(lanes), "i8")
    noted, fresh_at = [], []
    while len(row):
        run = runs[lanes[row]]
        fresh = run == 0
        r, value, sign = np.full(len(row), 64), np.zeros(len(row), bool), 0
        if fresh.any():
            window, f = bits.look(p)
            found = np.where(fresh, table[(window >> (24 - f)) & 0xFFFF], 0)
            n, r0, s0 = found >> 8, (found >> 4) & 15, found & 15
            if not n[fresh].all() or s0.max() > 1:
                raise ValueError("no such refinement code")
            end = fresh & (s0 == 0) & (r0 < 15)
            more = np.where(end, r0, s0)
            v = (window >> (40 - f - n - more)) & ((1 << more) - 1)
            p = p + n + np.where(fresh, more, 0)
            run = np.where(end, (1 << r0) + v, run)
            go = fresh & ~end
            r, value, sign = np.where(go, r0, r), go & (s0 > 0), np.where(v > 0, step, -step)
        inside = z + r < n_zeros[row]
        stop = np.where(inside, zero_at[np.where(inside, first_zero[row] + z + r, -1)], width)
        begin = behind[row, k].astype("i8")
        count = behind[row, stop] - begin
        noted.append((first_old[row] + begin, count, p))
        p = p + count
        if (put := value & inside).any():
            fresh_at.append((block[row[put]] * 64 + a + stop[put], sign[put]))
        runs[lanes[row]] = np.where(run > 0, run - 1, 0)
        k, z = stop + 1, z + r + 1
        done = (k >= width) | (run > 0)
        if done.any():
            bits.pos[lanes[row[done]]] = p[done]
            stay = ~done
            row, p, k, z = row[stay], p[stay], k[stay], z[stay]
    flat = coefficients.reshape(-1)
    first, count, at = (np.concatenate(x) for x in zip(*noted))
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, which = np.repeat(at, count) + within, np.repeat(first, count) + within
    if len(at):
        if at.max() > bits.most:
            raise ValueError("a scan ends early")
        hit = block[old_row[which]] * 64 + a + old_at[which]
        was = flat[hit]
        fix = (bits.one(at) == 1) & ((np.abs(was) & step) == 0)
        flat[hit[fix]] = was[fix] + np.where(was[fix] > 0, step, -step)
    for at, sign in fresh_at:
        flat[at] = sign


def read_payload(blocks: list[np.ndarray], picture: Picture) -> bytes:
    """The bytes that ``encode_payloads`` stored."""
    n = next((int(x[len(_TAG) :]) for x in picture.notes if x.startswith(_TAG)), None)
    if n is None:
        raise ValueError("the file holds no payload")
    rows, cols = picture.height // 16, picture.width // 16
    v = np.empty((rows * cols, 6, 64), "i4")
    luma = np.empty((rows * cols * 4, 64), "i4")
    luma[_luma_raster(rows, cols)] = blocks[0]
    v[:, :4], v[:, 4], v[:, 5] = luma.reshape(-1, 4, 64), blocks[1], blocks[2]
    if np.abs(v).max(initial=0) > 128:
        raise ValueError("a coefficient stands for no byte")
    return _byte_of_coefficient()[v + 128].tobytes()[:n]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a progressive JPEG file, written to a table in shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for whole in batches:
            for batch in sliced(whole, 1, _SLICE_BYTES, _SLICE_BYTES, UNIT):
                sizes, payloads = zip(*map(payload_of, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(encode_payloads(list(payloads)), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


_DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def _decoded(files: list[bytes | None]) -> list[tuple | None]:
    """What ``decode_many`` gives of each file; null for null or damaged files."""
    try:
        found = iter(decode_many([f for f in files if f is not None]))
        return [None if f is None else next(found) for f in files]
    except _DAMAGED:  # one by one, to find the damaged
        return [_or_none(f) for f in files]


def _or_none(file: bytes | None):
    try:
        return None if file is None else decode_many([file])[0]
    except _DAMAGED:
        return None


def _payload_or_none(found: tuple | None) -> bytes | None:
    try:
        return None if found is None else read_payload(found[1], found[2])
    except _DAMAGED:
        return None


def tensors(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, height, width, rgb): the full-resolution tensor of each file, row by row, R G B; null for null or damaged files."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return decode_media(rows).select("id", "height", "width", "rgb")


def decode_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """*media* with payload (if the file holds one), height, width and rgb (the RGB tensor, row by row) of each file.

    Columns of *media* that have these names give way.
    """
    new = {"payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}
    rest = [c for c in media.columns if c not in new]
    place = rest.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for whole in batches:
            for batch in sliced(whole, place, _SLICE_BYTES, _SLICE_BYTES, UNIT):
                found = _decoded(batch.column(place).to_pylist())
                rgb = [None if x is None else x[0] for x in found]
                columns = [map(_payload_or_none, found), *([None if x is None else x.shape[k] for x in rgb] for k in (0, 1)), [None if x is None else x.tobytes() for x in rgb]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, new.values()))], [*rest, *new])

    rows = media.select(*(F.col(f"`{c}`") for c in rest))
    fields = [StructField(name, IntegerType() if name in ("height", "width") else BinaryType()) for name in new]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *fields]))
