"""The decoder against a scalar encoder written from the standard, and payload round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from kinetrail.llm import progressive_jpeg as pj

from .fixtures import AWKWARD, documents

AC_SYMBOLS = list(range(256))
AC_LENGTHS = [8] * 254 + [9] * 2
DC_SYMBOLS, DC_LENGTHS = list(range(16)), [5] * 16


class Writer:
    """One scan's bits, symbol by symbol."""

    def __init__(self, interval=0):
        self.bits, self.data, self.interval, self.marks = [], bytearray(), interval, 0

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def symbol(self, s, ac):
        symbols, lengths = (AC_SYMBOLS, AC_LENGTHS) if ac else (DC_SYMBOLS, DC_LENGTHS)
        codes = pj._codes(lengths)
        self.put(codes[symbols.index(s)], lengths[symbols.index(s)])

    def flush(self):
        while len(self.bits) % 8:
            self.bits.append(1)
        for i in range(0, len(self.bits), 8):
            b = int("".join(map(str, self.bits[i : i + 8])), 2)
            self.data.append(b)
            if b == 255:
                self.data.append(0)
        self.bits = []

    def restart(self):
        self.flush()
        self.data += bytes([255, 0xD0 + self.marks % 8])
        self.marks += 1


def magnitude(v):
    return abs(v).bit_length()


class Coder:
    """Encodes blocks of a scan in order; end-of-band runs and buffered corrections as in the standard."""

    def __init__(self, writer, start, end, high, low):
        self.w, self.start, self.end, self.high, self.low = writer, start, end, high, low
        self.run, self.late, self.last = 0, [], {}

    def end_runs(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.w.symbol(n << 4, True)
            if n:
                self.w.put(self.run & ((1 << n) - 1), n)
            self.run = 0
        for b in self.late:
            self.w.put(b, 1)
        self.late = []

    def reset(self):
        self.end_runs()
        self.last = {}

    def dc(self, block, c):
        if self.high:
            self.w.put((int(block[0]) >> self.low) & 1, 1)
            return
        v = int(block[0]) >> self.low
        d = v - self.last.get(c, 0)
        self.last[c] = v
        n = magnitude(d)
        self.w.symbol(n, False)
        self.w.put(d if d >= 0 else d + (1 << n) - 1, n)

    def ac(self, block):
        if self.high:
            return self.refine(block)
        r = 0
        for k in range(self.start, self.end + 1):
            v = int(block[k])
            v = v >> self.low if v >= 0 else -(-v >> self.low)
            if not v:
                r += 1
                continue
            self.end_runs()
            while r > 15:
                self.w.symbol(0xF0, True)
                r -= 16
            n = magnitude(v)
            self.w.symbol(r << 4 | n, True)
            self.w.put(v if v > 0 else v + (1 << n) - 1, n)
            r = 0
        if r:
            self.run += 1
            if self.run == 0x7FFF:
                self.end_runs()

    def refine(self, block):
        size = [abs(int(v)) >> self.low for v in block]
        eob = max((k for k in range(self.start, self.end + 1) if size[k] == 1), default=-1)
        r, mine = 0, []
        for k in range(self.start, self.end + 1):
            if not size[k]:
                r += 1
                continue
            while r > 15 and k <= eob:
                self.end_runs()
                self.w.symbol(0xF0, True)
                for b in mine:
                    self.w.put(b, 1)
                r, mine = r - 16, []
            if size[k] > 1:
                mine.append(size[k] & 1)
                continue
            self.end_runs()
            self.w.symbol(r << 4 | 1, True)
            self.w.put(int(block[k] > 0), 1)
            for b in mine:
                self.w.put(b, 1)
            r, mine = 0, []
        if r or mine:
            self.run += 1
            self.late += mine


SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


def encode(width, height, sampling, blocks, quant, script, interval=0):
    """A file of coefficient grids (rows, cols, 64) padded to whole units, zigzag order."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(quant)
    out += b"\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * len(sampling), 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    out += pj._table(0, DC_SYMBOLS, DC_LENGTHS) + pj._table(0x10, AC_SYMBOLS, AC_LENGTHS)
    out += b"\xff\xdd\x00\x04" + struct.pack(">H", interval)
    for parts, start, end, high, low in script:
        w = Writer()
        coder = Coder(w, start, end, high, low)
        if len(parts) == 1:
            h, v = sampling[parts[0]]
            cols, rows = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            units = [[(parts[0], blocks[parts[0]][r, c])] for r in range(rows) for c in range(cols)]
        else:
            units = [[(c, blocks[c][my * v + y, mx * h + x]) for c in parts for h, v in [sampling[c]] for y in range(v) for x in range(h)] for my in range(mh) for mx in range(mw)]
        for i, unit in enumerate(units):
            if interval and i and i % interval == 0:
                coder.reset()
                w.restart()
            for c, b in unit:
                coder.ac(b) if start else coder.dc(b, c)
        coder.end_runs()
        w.flush()
        out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([start, end, high << 4 | low]) + bytes(w.data)
    return out + b"\xff\xd9"


def random_blocks(draw, width, height, sampling):
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = []
    for h, v in sampling:
        b = draw.integers(-9, 10, (mh * v, mw * h, 64)) * (draw.uniform(size=(mh * v, mw * h, 64)) < draw.choice([0.02, 0.3, 0.9]))
        b[..., 0] = draw.integers(-300, 300, b.shape[:2])
        b[draw.uniform(size=b.shape[:2]) < 0.4, 1:] = 0
        out.append(b)
    return out


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("sampling", [((2, 2), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
def test_coefficients_of_general_files(sampling, interval):
    draw = np.random.default_rng(interval + 10 * len(sampling))
    cases = [(w, h, random_blocks(draw, w, h, sampling)) for w, h in ((8, 8), (37, 21), (64, 16), (5, 70))]
    quant = [1] * 64
    found = pj.decode_many([encode(w, h, sampling, b, quant, SCRIPT, interval) for w, h, b in cases])
    hm, vm = sampling[0]
    for (w, h, want), (rgb, got, _) in zip(cases, found):
        assert rgb.shape == (h, w, 3)
        for c, (a, b) in enumerate(zip(want, got)):
            b = b.reshape(a.shape)
            ch, cv = sampling[c]
            rows, cols = -(-(-(-h * cv // vm)) // 8), -(-(-(-w * ch // hm)) // 8)
            assert (a[..., 0] == b[..., 0]).all()
            assert (a[:rows, :cols] == b[:rows, :cols]).all()


def test_pixels_equal_the_plain_transform():
    draw = np.random.default_rng(3)
    quant = draw.integers(1, 20, 64).tolist()
    blocks = [draw.integers(-12, 13, (2, 2, 64)) * (draw.uniform(size=(2, 2, 64)) < 0.2) for _ in range(1)]
    rgb, _, _ = pj.decode_many([encode(16, 16, ((1, 1),), blocks, quant, [((0,), 0, 0, 0, 0), ((0,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0)])])[0]
    for r in range(2):
        for c in range(2):
            f = np.zeros(64)
            f[pj.zigzag()] = blocks[0][r, c] * np.array(quant)
            f = f.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((1 / np.sqrt(2) if u == 0 else 1) * (1 / np.sqrt(2) if v == 0 else 1) / 4 * f[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
                    assert abs(int(rgb[8 * r + y, 8 * c + x, 0]) - np.clip(s + 128, 0, 255)) <= 0.51


def test_colours_and_upsampled_chroma():
    flat = lambda v, n=1: np.pad(np.full((n, n, 1), v), ((0, 0), (0, 0), (0, 63)))
    rgb, _, _ = pj.decode_many([encode(16, 16, ((2, 2), (1, 1), (1, 1)), [flat(-416, 2), flat(-344), flat(1016)], [1] * 64, SCRIPT)])[0]
    assert (np.abs(rgb.reshape(-1, 3).astype(int) - [254, 0, 0]) <= 2).all()  # pure red: 76, 85, 255
    y = np.zeros((2, 2, 64), int)
    assert pj.decode_many([encode(16, 16, ((2, 2), (1, 1), (1, 1)), [y, flat(0), flat(0)], [1] * 64, SCRIPT)])[0][0].reshape(-1, 3).tolist() == [[128] * 3] * 256


def test_zigzag_order():
    assert pj.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(pj.zigzag().tolist()) == list(range(64))


def test_payload_round_trips():
    draw = np.random.default_rng(5)
    payloads = [draw.integers(0, 256, 576 * k, dtype="u1").tobytes() for k in (1, 2, 3, 11)] + [bytes([v]) * 576 for v in (0, 1, 2, 32, 101, 127, 128, 253, 254, 255)]
    payloads += [draw.choice(np.frombuffer(b"\xff\xff\xff\xff\xff e", "u1"), 576 * 3, p=[0.19] * 5 + [0.03, 0.02]).tobytes() for _ in range(6)]  # long runs of zeros
    payloads += [b"some plain words here, " * 100 + b"\xff" * 4]
    files = pj.encode_payloads(payloads)
    assert [pj.read_payload(b, p) for _, b, p in pj.decode_many(files)] == payloads
    assert files == [pj.encode_payloads([p])[0] for p in payloads]
    assert len(files[-1]) < len(payloads[-1])


def test_stored_files_equal_the_plain_encoder(monkeypatch):
    """The same coefficients through the scalar encoder above, with the stored form's tables."""
    draw = np.random.default_rng(9)
    text = b"It was the best of times, it was the worst \xc3\xa9 of times. " * 30
    payloads = [text + b"\xff" * (-len(text) % 576), draw.choice(np.frombuffer(b"\xff\xff\xff e\x00", "u1"), 576 * 4).tobytes()]
    together = ((0, 1, 2), 0, 0)
    script = [(*together, 0, 1), (*together, 1, 0), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1)] + [((c,), 1, 63, 1, 0) for c in range(3)]
    for payload, file in zip(payloads, pj.encode_payloads(payloads)):
        rows, cols = pj._grid(len(payload))
        v = pj.coefficient_of_byte()[np.frombuffer(payload + b"\xff" * (rows * cols * 384 - len(payload)), "u1")].reshape(rows, cols, 6, 64)
        luma = v[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * rows, 2 * cols, 64)
        blocks = [luma, v[:, :, 4], v[:, :, 5]]

        def symbol(self, s, ac):
            kind = "dc" if not ac else "first" if not self.refines else "refine"
            symbols, lengths = pj._huffman(kind)
            self.put(pj._codes(lengths)[symbols.index(s)], lengths[symbols.index(s)])

        monkeypatch.setattr(Writer, "symbol", symbol)
        monkeypatch.setattr(Writer, "refines", False, raising=False)
        plain = Coder.refine
        monkeypatch.setattr(Coder, "refine", lambda self, block: (setattr(self.w, "refines", True), plain(self, block)))
        want = encode(16 * cols, 16 * rows, ((2, 2), (1, 1), (1, 1)), blocks, [1] * 64, script, pj.RESTART)
        assert [s.data for s in pj.parse(file).scans] == [s.data for s in pj.parse(want).scans]
        monkeypatch.undo()


def test_coefficients_are_a_permutation_and_codes_are_valid():
    assert sorted(pj.coefficient_of_byte().tolist()) == list(range(-127, 129)) and pj.coefficient_of_byte()[255] == 0
    for kind in ("dc", "first", "refine"):
        symbols, lengths = pj._huffman(kind)
        assert len(set(symbols)) == len(symbols) and sum(2.0**-n for n in lengths) < 1 and max(lengths) <= 16


def test_a_payload_of_many_rows_of_units():
    payload = np.random.default_rng(6).integers(0, 256, 576 * 2800, dtype="u1").tobytes()
    rgb, blocks, picture = pj.decode_many(pj.encode_payloads([payload]))[0]
    assert pj.read_payload(blocks, picture) == payload and rgb.shape[0] > 16


def test_damaged_files_raise():
    good = pj.encode_payloads([b"\x07" * 576])[0]
    for bad in (b"", b"GIF89a", good[:40], good[:-300], good.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError, KeyError, struct.error)):
            pj.decode_many([bad])


def test_awkward_texts(spark, tmp_path, monkeypatch):
    from kinetrail.llm import queries

    docs = documents(spark, AWKWARD + [AWKWARD[5]], ids=[*range(len(AWKWARD)), 5])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_progressive_jpeg(spark, str(tmp_path)).collect()
    out = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) + 1 and len([r for r in rows if r.doc_id == 5]) == 2
    media = pj.store_texts(docs)
    assert all("/media-" in f for f in media.inputFiles())  # written, and read from there
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, t in enumerate(AWKWARD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r, (rgb, _, _) = out[i], pj.decode_many([files[i]])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
        assert r.feature == f"{rgb.shape[1]}x{rgb.shape[0]} rgb {zlib.crc32(rgb.tobytes()):08x}"
    assert out[0].feature == out[1].feature and out[5].feature == out[6].feature != out[4].feature
    assert pj.decode_media(pj.store_texts(docs.where("false"))).count() == 0


def test_decoded_columns(spark):
    rows = [(1, pj.encode_payloads([b"a" * 576])[0], "clash", 7), (2, None, "x", 8), (3, b"junk", "y", 9)]
    found = pj.decode_media(spark.createDataFrame(rows, "id long, media binary, rgb string, n int"))
    assert found.columns == ["id", "media", "n", "payload", "height", "width", "rgb"]
    out = {r.id: r for r in found.collect()}
    assert bytes(out[1].payload) == b"a" * 576 and out[1].n == 7 and (out[1].height, out[1].width) == (16, 32)
    assert out[2].payload is None and out[3].rgb is None


def test_tensor_column(spark):
    rows = [(1, pj.encode_payloads([b"a" * 576])[0]), (2, None), (3, b"junk"), (4, b"")]
    out = {r.id: r for r in pj.tensors(spark.createDataFrame(rows, "id long, media binary"), "id").collect()}
    assert (out[1].height, out[1].width, len(out[1].rgb)) == (16, 32, 16 * 32 * 3)
    assert out[2].rgb is None and out[3].rgb is None and out[4].rgb is None
