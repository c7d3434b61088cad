"""Media columns: progressive JPEG as a lossless store, decoded to RGB tensors.

A progressive JPEG refines quantised DCT coefficients scan by scan. The decoder
here accumulates spectral-selection and successive-approximation scans (DC and
AC, first and refining, with end-of-band runs and restart intervals) into
coefficient arrays, inverse-transforms them with an integer-scaled matrix in
numpy (exact, so equal files give equal tensors on any machine), upsamples
chroma by repetition, and converts to full-resolution RGB.

Payloads are stored in what the format keeps losslessly, its coefficients: each
byte b is the AC coefficient of magnitude 128 + (b >> 1), negative if b is odd.
A block keeps 63 bytes, a 4:2:0 unit six blocks: luma blocks in raster order,
then Cb, then Cr. A comment segment holds the lengths. The scans: DC, the AC
bands 1-5 and 6-63 without their lowest bit, the lowest bit of all AC
coefficients, that of DC. As no coefficient is zero, every scan's Huffman table
needs one code of one bit, and numpy writes and reads such scans whole;
other streams go through the sequential decoder.

Nulls are stored like empty texts: one payload of spaces. A text of any length
is one image (up to 6 GB). Equal texts give equal files and tensors.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from math import cos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
UNIT = 192
CELL = 6 * 63
#: Payload bytes that are worked on at once.
GROUP = 1_500_000
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Fixed-point bits of one pass of the inverse transform and of the colour matrix.
BITS, COLOUR = 10, 16


def zigzag() -> np.ndarray:
    """Place in the block of the k-th coefficient of a scan."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def _inverse_matrix() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: pixels; whole numbers scaled by 2^(2 BITS)."""
    one = np.array([[round((sqrt(0.5) if u == 0 else 1) / 2 * cos((2 * x + 1) * u * pi / 16) * 2**BITS) for x in range(8)] for u in range(8)], np.float64)
    return np.kron(one, one)[ZIGZAG]


_INVERSE = _inverse_matrix()


# --- writing payloads -------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, symbol: int) -> bytes:
    """A table with one code, the bit 0."""
    return _segment(0xC4, bytes([kind << 4 | ident, 1, *[0] * 15, symbol]))


def _scan(components: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body) + data


def shape(payload: int) -> tuple[int, int]:
    """(units across, units down) of the image for so many bytes."""
    units = max(1, -(-payload // CELL))
    across = min(4095, max(1, int(sqrt(units))))
    return across, -(-units // across)


def encode_payloads(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """A JPEG for each payload; ``lengths`` (of the texts) go into its comment."""
    shapes = [shape(len(p)) for p in payloads]
    cells = [a * d for a, d in shapes]
    raw = np.frombuffer(b"".join(p.ljust(n * CELL, b"\0") for p, n in zip(payloads, cells, strict=True)), np.uint8).reshape(-1, 63)
    # magnitude without its lowest bit, one's complement if negative: seven bits after the code bit 0
    upper = 64 + (raw >> 2)
    first = np.where(raw & 1, 127 - upper, upper).astype(np.uint8)
    near, far = np.ascontiguousarray(first[:, :5]), np.ascontiguousarray(first[:, 5:])
    refine = np.packbits(np.concatenate([np.zeros((len(raw), 1), np.uint8), raw >> 1 & 1], axis=1), axis=1)
    flat_dc = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    tables = _huffman(0, 0, 0) + _huffman(1, 0, 0x07) + _huffman(1, 1, 0x00)
    out, at = [], 0
    for p, n, (across, down), length in zip(payloads, cells, shapes, lengths, strict=True):
        ends = [at, at + 4 * n, at + 5 * n, at + 6 * n]
        at = ends[3]
        part = [(c + 1, slice(ends[c], ends[c + 1])) for c in range(3)]
        none = np.packbits(np.concatenate([np.zeros(6 * n, np.uint8), np.ones(-6 * n % 8, np.uint8)])).tobytes()
        every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
        frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        pieces = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", len(p), length)), flat_dc, _segment(0xC2, frame), tables, _scan(every, 0, 0, 0, 1, none)]
        pieces += [_scan([(c, 0, 0)], 1, 5, 0, 1, near[s].tobytes()) for c, s in part]
        pieces += [_scan([(c, 0, 0)], 6, 63, 0, 1, far[s].tobytes()) for c, s in part]
        pieces += [_scan([(c, 0, 1)], 1, 63, 1, 0, refine[s].tobytes().replace(b"\xff", b"\xff\0")) for c, s in part]
        out.append(b"".join([*pieces, _scan(every, 0, 0, 1, 0, none), b"\xff\xd9"]))
    return out


# --- reading any progressive JPEG -------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:  # beyond the end: ones, as the padding
            return (1 << n) - 1
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x if not n or x >> n - 1 else x - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class Image:
    """The coefficients (zigzag order) and tables of a progressive JPEG."""

    def __init__(self, data: bytes, sequential: bool = False):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.comment, self.restart, self.sequential = b"", 0, sequential
        at = 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = m.start() if (m := _MARKER.search(data, at)) else len(data)
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a progressive JPEG")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            self.quant[ident] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
            at += 129 if wide else 65

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            key, counts, at = (body[at] >> 4, body[at] & 15), body[at + 1 : at + 17], at + 17
            table, code = {}, 0
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    table[n, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.tables[key] = table

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.parts:
            # those of whole units are stored; scans of one component cover only what the image needs
            c.cols, c.rows = self.across * c.h, self.down * c.v
            c.need = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coef = np.zeros((c.rows * c.cols, 64), np.int32)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [next(c for c in self.parts if c.ident == body[1 + 2 * i]) for i in range(n)]
        tables = [(self.tables.get((0, body[2 + 2 * i] >> 4), {}), self.tables.get((1, body[2 + 2 * i] & 15), {})) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        clean = lambda x: x.replace(b"\xff\0", b"\xff")
        if n == 1:
            c = chosen[0]
            blocks = np.arange(c.need[0] * c.need[1]) if c.need[0] == c.cols else (np.arange(c.need[1])[:, None] * c.cols + np.arange(c.need[0])).reshape(-1)
            order = [(0, blocks)]
        else:
            order = self._units(chosen)
        if not self.restart and not self.sequential and self._whole(chosen, order, tables, first, last, high, low, clean(data)):
            return
        units = self._sequence(order, n)
        step = self.restart or len(units)
        for k, part in enumerate(_RESTART.split(data) if self.restart else [data]):
            self._entropy(units[k * step : (k + 1) * step], chosen, tables, first, last, high, low, _Bits(clean(part)))

    def _units(self, chosen: list[Component]) -> list[tuple[int, np.ndarray]]:
        """Per component, its blocks in the order of the interleaved units."""
        out = []
        for i, c in enumerate(chosen):
            grid = np.arange(c.rows * c.cols).reshape(self.down, c.v, self.across, c.h)
            out.append((i, grid.transpose(0, 2, 1, 3).reshape(-1)))
        return out

    def _sequence(self, order, n: int) -> list[list[tuple[int, int]]]:
        if n == 1:
            return [[(0, int(b))] for b in order[0][1]]
        count = self.across * self.down
        each = [x.reshape(count, -1).tolist() for _, x in order]
        return [[(i, b) for i, x in enumerate(each) for b in x[u]] for u in range(count)]

    def _whole(self, chosen, order, tables, first, last, high, low, data: bytes) -> bool:
        """Reads a scan at once if its table has a single code of one bit and no block depends on another; False if not."""
        total = sum(len(b) for _, b in order)
        if first == 0:
            if high:
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=total) if 8 * len(data) >= total else None
            elif all(t[0] == {(1, 0): 0} for t in tables):
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=total) if 8 * len(data) >= total else None
                if bits is None or bits.any():
                    return False
                return True  # no differences: all stay zero
            else:
                return False
            if bits is None:
                return False
            if not bits.any():
                return True
            if len(chosen) > 1:
                return False
            chosen[0].coef[order[0][1], 0] |= bits.astype(np.int32) << low
            return True
        c, blocks, table = chosen[0], order[0][1], tables[0][1]
        width = last - first + 1
        if len(table) != 1 or (1, 0) not in table:
            return False
        symbol = table[1, 0]
        if not high:
            size = symbol & 15
            if symbol >> 4 or not size or len(data) != -(-len(blocks) * width * (1 + size) // 8):
                return False
            if size == 7:
                body = np.frombuffer(data, np.uint8).reshape(len(blocks), width).astype(np.int32)
                if (body & 0x80).any():
                    return False
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * width * (1 + size)).reshape(len(blocks), width, 1 + size)
                if bits[..., 0].any():
                    return False
                body = (bits[..., 1:].astype(np.int32) << np.arange(size - 1, -1, -1)).sum(axis=2)
            c.coef[blocks, first : last + 1] = np.where(body >> size - 1, body, body - (1 << size) + 1) << low
            return True
        if symbol or len(data) != -(-len(blocks) * (1 + width) // 8):
            return False
        band = c.coef[blocks, first : last + 1]
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * (1 + width)).reshape(len(blocks), 1 + width)
        if bits[:, 0].any() or not band.all():
            return False
        more = bits[:, 1:].astype(np.int32) << low
        c.coef[blocks, first : last + 1] = band + np.where(band > 0, more, -more)
        return True

    def _entropy(self, units, chosen, tables, first, last, high, low, bits: _Bits) -> None:
        """One restart interval, symbol by symbol."""
        before, run, one = [0] * len(chosen), 0, 1 << low
        for unit in units:
            for i, b in unit:
                coef = chosen[i].coef[b]
                if first == 0:
                    if high:
                        coef[0] |= bits.take(1) << low
                    else:
                        before[i] += bits.signed(bits.symbol(tables[i][0]))
                        coef[0] = before[i] << low
                    continue
                k = first
                if not high:
                    if run:
                        run -= 1
                        continue
                    while k <= last:
                        r, s = divmod(bits.symbol(tables[i][1]), 16)
                        if s:
                            k += r
                            x = bits.signed(s)
                            coef[k] = x * one
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            run = (1 << r) + (bits.take(r) if r else 0) - 1
                            break
                    continue
                if not run:
                    while k <= last:
                        r, s = divmod(bits.symbol(tables[i][1]), 16)
                        new = 0
                        if s:
                            new = one if bits.take(1) else -one
                        elif r < 15:
                            run = (1 << r) + (bits.take(r) if r else 0)
                            break
                        while k <= last:
                            if coef[k]:
                                self._correct(coef, k, one, bits)
                            elif r == 0:
                                coef[k] = new
                                k += 1
                                break
                            else:
                                r -= 1
                            k += 1
                if run:
                    for k in range(k, last + 1):
                        if coef[k]:
                            self._correct(coef, k, one, bits)
                    run -= 1

    @staticmethod
    def _correct(coef: np.ndarray, k: int, one: int, bits: _Bits) -> None:
        if bits.take(1) and not abs(int(coef[k])) & one:
            coef[k] += one if coef[k] > 0 else -one


def inverse_transform(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) of coefficients; whole numbers throughout."""
    out = np.empty((len(coef), 64), np.uint8)
    scaled = _INVERSE * quant[:, None]
    for i in range(0, len(coef), 8192):
        x = coef[i : i + 8192].astype(np.float64) @ scaled
        x += 128 * 4.0**BITS + 4.0**BITS / 2
        x *= 4.0**-BITS
        np.floor(x, out=x)
        out[i : i + 8192] = np.clip(x, 0, 255, out=x)
    return out.reshape(-1, 8, 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3)."""
    planes = []
    for c in image.parts:
        blocks = inverse_transform(c.coef, image.quant[c.quant]).reshape(c.rows, c.cols, 8, 8)
        plane = blocks.transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
        if (image.v, image.h) != (c.v, c.h):
            plane = plane.repeat(image.v // c.v, axis=0).repeat(image.h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    half = 1 << COLOUR - 1
    y, cb, cr = planes[0].astype(np.int32) << COLOUR, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    fixed = lambda x: round(x * (1 << COLOUR))
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, x in enumerate((y + fixed(1.402) * cr, y - fixed(0.344136) * cb - fixed(0.714136) * cr, y + fixed(1.772) * cb)):
        out[..., k] = np.clip(x + half >> COLOUR, 0, 255)
    return out


def payload(image: Image) -> tuple[bytes, int]:
    """(the stored payload, the length of its text)."""
    size, length = struct.unpack(">QQ", image.comment)
    v = np.concatenate([c.coef[:, 1:] for c in image.parts]).reshape(-1)[:size]
    return ((np.abs(v) - 128 << 1) | (v < 0)).astype(np.uint8).tobytes(), length


def pad(body: bytes) -> bytes:
    return body.ljust(max(UNIT, -(-len(body) // UNIT) * UNIT), b" ")


def _groups(sizes: list[int]) -> Iterator[slice]:
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > GROUP:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, media (JPEG)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [x or b"" for x in b.column("body").to_pylist()]
            for s in _groups([len(x) for x in bodies]):
                files = encode_payloads([pad(x) for x in bodies[s]], [len(x) for x in bodies[s]])
                yield pa.record_batch({"doc_id": b.column("doc_id")[s.start : s.stop], "media": pa.array(files, pa.binary())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return mapped(slim, run, "doc_id long, media binary")


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, height, width, tensor (RGB bytes by row; only if ``tensors``), payload, n_bytes, feature.

    ``feature``: size, mean of each channel, and CRC-32 of the tensor.
    """

    def one(data: bytes):
        image = Image(data)
        x = rgb(image)
        body, length = payload(image) if len(image.comment) == 16 else (b"", 0)
        means = x.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (x.shape[0] * x.shape[1])
        raw = x.tobytes()
        feature = f"{x.shape[0]}x{x.shape[1]};" + ",".join(f"{m:.3f}" for m in means) + f";{zlib.crc32(raw):08x}"
        return (x.shape[0], x.shape[1], body, length, feature), raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            for s in _groups([len(x) for x in files]):
                got = [one(x) for x in files[s]]
                h, w, body, length, feature = zip(*[g[0] for g in got], strict=True)
                out = {"doc_id": b.column("doc_id")[s.start : s.stop], "height": pa.array(h, pa.int32()), "width": pa.array(w, pa.int32())}
                if tensors:
                    out["tensor"] = pa.array([g[1] for g in got], pa.binary())
                digest = [hashlib.sha256(x).hexdigest() for x in files[s]]
                yield pa.record_batch(out | {"payload": pa.array(body, pa.binary()), "n_bytes": pa.array(length, pa.int64()), "media_bytes": pa.array([len(x) for x in files[s]], pa.int64()), "media_sha256": pa.array(digest), "feature": pa.array(feature)})

    kinds = "doc_id long, height int, width int" + (", tensor binary" if tensors else "")
    return mapped(media.select("doc_id", "media"), run, kinds + ", payload binary, n_bytes long, media_bytes long, media_sha256 string, feature string")
