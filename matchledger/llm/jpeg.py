"""Media columns as progressive JPEG (operator 8).

``decode_file`` reads a progressive JPEG: each scan adds a band of frequencies (spectral selection) or one more bit of
them (successive approximation) to the components' coefficient arrays; a matrix product turns blocks into samples, chroma
is repeated to full resolution, and an RGB tensor (height, width, 3; 8 bits) results. Scans whose Huffman table has one
symbol, and correction bits of whole blocks, are read as arrays; other scans symbol by symbol. Restart intervals,
arithmetic coding and samples of more than 8 bits aren't read: such a file, like a broken one, gives a null tensor.

``payload_file`` stores bytes without loss. The unit is a coefficient: a byte is the 8 extra bits of a coefficient of
size 8, so each AC coefficient holds one (DC stays 0). Three components at 4:2:0 fill row by row, luma first; byte 255
fills the rest, and a comment holds the payload's length. Upper bits go into scans of two bands, the lowest into a third.

Null text counts as empty. Rows and repeats are kept as they are; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table

UNIT = 576
#: Largest number of macroblocks in a row, unless there would be more rows of them than a picture can have.
ACROSS = 64
DOWN = 65535 // 16
#: Blocks that are turned into samples at once.
STRIP = 16384
BANDS = ((1, 5), (6, 63))


def zigzag() -> np.ndarray:
    """The place (8 * row + column) of each coefficient: along the diagonals, turning at each edge."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Row k: the 64 samples of coefficient k in zigzag order. Values are multiples of 2**-24, so that sums of
    products with whole numbers are exact in any order."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[:, None] / 2
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(both[zigzag()] * 2**24) / 2**24


class Codes:
    """A Huffman table: the symbol and the length of the code that any 16 bits begin with (length 0: none)."""

    def __init__(self, counts: bytes, symbols: bytes):
        lengths = np.repeat(np.arange(1, 17), list(counts))
        steps = 1 << (16 - lengths)
        if len(symbols) < len(lengths) or steps.sum() > 1 << 16:
            raise ValueError("a table holds too many codes")
        rest = (1 << 16) - int(steps.sum())
        self.length = np.concatenate([np.repeat(lengths, steps), np.zeros(rest, np.int64)]).astype(np.uint8).tobytes()
        self.symbol = np.concatenate([np.repeat(np.frombuffer(symbols[: len(lengths)], np.uint8), steps), np.zeros(rest, np.uint8)]).tobytes()
        #: The only symbol, where there is one, of one bit.
        self.only = symbols[0] if lengths.tolist() == [1] else None


@lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> Codes:
    return Codes(counts, symbols)


NO_CODES = Codes(bytes(16), b"")


class Bits:
    """The bits of one scan, byte stuffing removed."""

    def __init__(self, data: np.ndarray):
        stuffed = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0)) + 1
        data = np.delete(data, stuffed) if len(stuffed) else data
        self.raw, self.bits = data.tobytes() + bytes(4), np.unpackbits(data)
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise ValueError("the scan ends early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def next16(self) -> int:
        """The next 16 bits, zeros after the last."""
        k = self.at >> 3
        return int.from_bytes(self.raw[k : k + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def number(self, n: int) -> int:
        out = self.next16() >> (16 - n)
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return out

    def symbol(self, table: Codes) -> int:
        window = self.next16()
        length = table.length[window]
        self.at += length
        if not length or self.at > len(self.bits):
            raise ValueError("no such code")
        return table.symbol[window]

    def signed(self, size: int) -> int:
        v = self.number(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def uniform(bits: Bits, n: int, size: int) -> np.ndarray:
    """n values of one size, each after the one-bit code of the table's only symbol."""
    rows = bits.take(n * (1 + size)).reshape(n, 1 + size)
    if rows[:, 0].any():
        raise ValueError("no such code")
    if not size:
        return np.zeros(n, np.int32)
    if size == 7:
        value = np.packbits(rows, axis=1)[:, 0].astype(np.int32)
    else:
        value = rows[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
    return np.where(value >> (size - 1), value, value - (1 << size) + 1)


class Component:
    def __init__(self, ident: int, across: int, down: int, quantiser: int):
        self.ident, self.h, self.v, self.quantiser = ident, across, down, quantiser
        self.blocks = np.zeros((0, 0, 64), np.int32)  # padded to whole macroblocks; in zigzag order
        self.rows = self.columns = 0  # blocks that scans of this component alone cover


@lru_cache(maxsize=64)
def _interleaved(grid: tuple[int, int], sizes: tuple[tuple[int, int], ...]) -> list[tuple]:
    """(component, rows, columns) of the blocks at each place of all macroblocks."""
    my, mx = (x.ravel() for x in np.mgrid[: grid[0], : grid[1]])
    return [(j, my * v + dy, mx * h + dx) for j, (v, h) in enumerate(sizes) for dy in range(v) for dx in range(h)]


@lru_cache(maxsize=1)
def chroma() -> list[np.ndarray]:
    """What each value of a chroma sample adds: red of the second, blue and green of the first, green of the second; the greens
    in 16-bit fixed point."""
    x = np.arange(256) - 128
    red, blue = (np.floor(f * 65536 * x / 65536 + 0.5).astype(np.int32) for f in (1.402, 1.772))
    return [red, blue, *(np.rint(f * 65536 * x).astype(np.int32) for f in (-0.344136, -0.714136))]


def _dc_scan(bits: Bits, parts: list[tuple[Component, Codes, Codes]], grid: tuple[int, int], high: int, low: int) -> None:
    if len(parts) == 1:
        c = parts[0][0]
        r, k = np.divmod(np.arange(c.rows * c.columns), c.columns)
        order = [(0, r, k)]
        step = 1
    else:  # macroblock by macroblock
        order = _interleaved(grid, tuple((c.v, c.h) for c, _, _ in parts))
        step = len(order)
    n = len(order[0][1])
    if high:
        got = bits.take(n * step).reshape(n, step).astype(np.int32) << low
        for i, (j, r, k) in enumerate(order):
            parts[j][0].blocks[r, k, 0] |= got[:, i]
        return
    sizes = {p[1].only for p in parts}
    if len(sizes) == 1 and None not in sizes:
        diffs = uniform(bits, n * step, sizes.pop()).reshape(n, step)
    else:
        diffs = np.array([[bits.signed(bits.symbol(parts[j][1])) for j, _, _ in order] for _ in range(n)]).reshape(n, step)
    for j, (c, _, _) in enumerate(parts):
        own = [i for i, o in enumerate(order) if o[0] == j]
        values = np.cumsum(diffs[:, own].ravel()).reshape(n, len(own)) << low
        for i, o in enumerate(own):
            c.blocks[order[o][1], order[o][2], 0] = values[:, i]


def _ac_scan(bits: Bits, c: Component, table: Codes, first: int, last: int, high: int, low: int) -> None:
    count, width = c.rows * c.columns, last - first + 1
    band = c.blocks[: c.rows, : c.columns, first : last + 1].reshape(count, width)
    only = table.only
    if not high and only is not None and 0 < only < 16:
        band[:] = uniform(bits, count * width, only).reshape(count, width) << low
    else:
        one, i = 1 << low, 0
        while i < count:
            k, block = 0, band[i]
            run = 0
            while k < width:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + (bits.number(zeros) if zeros else 0)
                    break
                value = 0
                if size:
                    value = bits.signed(size) << low if not high else (one if bits.number(1) else -one)
                while k < width:  # skip zeros; in a refinement, coefficients met on the way get their next bit
                    if high and block[k]:
                        if bits.number(1) and not abs(block[k]) & one:
                            block[k] += one if block[k] > 0 else -one
                    elif zeros:
                        zeros -= 1
                    else:
                        block[k] = value
                        k += 1
                        break
                    k += 1
            if not run:
                i += 1
                continue
            if high:  # an end-of-band run: correction bits only, for the rest of this block and for whole ones after it
                rest = band[i : i + run]
                place = rest != 0
                place[0, :k] = False
                got = bits.take(int(place.sum())).astype(np.int32) * one
                old = rest[place]
                rest[place] = np.where(np.abs(old) & one, old, np.where(old > 0, old + got, old - got))
            i += run
    c.blocks[: c.rows, : c.columns, first : last + 1] = band.reshape(c.rows, c.columns, width)


class Picture:
    """The coefficient arrays of a progressive JPEG."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.comment, self.components = b"", []
        quantisers: dict[int, np.ndarray] = {}
        tables: dict[tuple[int, int], Codes] = {}
        edges = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                if data[at : at + 2] == b"\xff\xd9":
                    break
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xC2:
                if body[0] != 8:
                    raise ValueError("samples must have 8 bits")
                self._frame(body)
            elif kind == 0xDA:
                stop = edges[np.searchsorted(edges, at)]
                self._scan(body, Bits(raw[at:stop]), tables)
                at = int(stop)
            elif kind == 0xDD and body != b"\0\0" or 0xC0 <= kind <= 0xCF:
                raise ValueError("this kind isn't read")
        if not self.components:
            raise ValueError("there is no picture")
        self.quantisers = quantisers

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.grid = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
        for c in self.components:
            c.rows, c.columns = -(-self.height * c.v // (8 * self.v)), -(-self.width * c.h // (8 * self.h))
            c.blocks = np.zeros((self.grid[0] * c.v, self.grid[1] * c.h, 64), np.int32)

    def _scan(self, body: bytes, bits: Bits, tables: dict) -> None:
        n = body[0]
        first, last, step = body[1 + 2 * n : 4 + 2 * n]
        names = {c.ident: c for c in self.components}
        parts = [(names[body[1 + 2 * i]], tables.get((0, body[2 + 2 * i] >> 4), NO_CODES), tables.get((1, body[2 + 2 * i] & 15), NO_CODES)) for i in range(n)]
        if first == 0:
            _dc_scan(bits, parts, self.grid, step >> 4, step & 15)
        else:
            _ac_scan(bits, parts[0][0], parts[0][2], first, last, step >> 4, step & 15)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) of 8 bits; a picture of one component is grey."""
        planes = []
        for c in self.components:
            blocks, factors = c.blocks.reshape(-1, 64), self.quantisers[c.quantiser].astype(np.float64)
            samples = np.empty(blocks.shape, np.uint8)
            for k in range(0, len(blocks), STRIP):
                part = np.rint((blocks[k : k + STRIP] * factors) @ basis()) + 128
                samples[k : k + STRIP] = np.clip(part, 0, 255, out=part)
            down, across = c.blocks.shape[:2]
            plane = samples.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            if c.v != self.v:
                plane = plane.repeat(self.v // c.v, axis=0)
            if c.h != self.h:
                plane = plane.repeat(self.h // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = planes[0].astype(np.int32), planes[1], planes[2]
        red, blue, green_b, green_r = chroma()
        out = np.empty((self.height, self.width, 3), np.uint8)
        out[:, :, 0] = np.clip(y + red[cr], 0, 255)
        out[:, :, 1] = np.clip(y + ((green_b[cb] + green_r[cr] + 32768) >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + blue[cb], 0, 255)
        return out


def decode_file(data: bytes) -> np.ndarray:
    return Picture(data).rgb()


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman(kind: int, ident: int, symbols: bytes, length: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | ident]) + bytes(len(symbols) if i == length else 0 for i in range(1, 17)) + symbols)


def _stuffed(bits: np.ndarray) -> bytes:
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))
    full = np.flatnonzero(data == 0xFF)
    return (np.insert(data, full + 1, 0) if len(full) else data).tobytes()


def _bits_of(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def payload_file(payload: bytes) -> bytes:
    """A progressive JPEG whose AC coefficients are the payload's bytes."""
    macroblocks = max(1, -(-len(payload) // (6 * 63)))
    across = min(macroblocks, max(ACROSS, -(-macroblocks // DOWN)))
    down = -(-macroblocks // across)
    macroblocks = across * down
    data = np.full(macroblocks * 6 * 63, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 63)
    own = [blocks[: 4 * macroblocks], blocks[4 * macroblocks : 5 * macroblocks], blocks[5 * macroblocks :]]
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, frame)]
    # Tables with one symbol: DC size 0 and AC size 7, one bit each; and the end-of-band runs, four bits each.
    out += [_huffman(0, 0, b"\0", 1), _huffman(1, 0, b"\7", 1), _huffman(1, 1, bytes(r << 4 for r in range(15)), 4)]
    every = bytes([3, 1, 0, 2, 0, 3, 0])
    for step in (0x01, 0x10):
        out += [_segment(0xDA, every + bytes([0, 0, step])), _stuffed(np.zeros(6 * macroblocks, np.uint8))]
    for i, part in enumerate(own, 1):
        # A coefficient of size 8 without its lowest bit has size 7: a zero bit and 7 bits make one byte, never 255.
        upper = np.where(part < 128, 127 - ((255 - part) >> 1), part >> 1).astype(np.uint8)
        for first, last in BANDS:
            out += [_segment(0xDA, bytes([1, i, 0, first, last, 1])), upper[:, first - 1 : last].tobytes()]
    for i, part in enumerate(own, 1):
        lowest = np.where(part < 128, 255 - part, part) & 1
        bits, at = [], 0
        while at < len(part):
            left = len(part) - at
            r = min(14, left.bit_length() - 1)
            run = min(left, (2 << r) - 1)
            bits += [np.array(_bits_of(r, 4) + _bits_of(run - (1 << r), r), np.uint8), lowest[at : at + run].ravel()]
            at += run
        out += [_segment(0xDA, bytes([1, i, 1, 1, 63, 0x10])), _stuffed(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


def payload_of(picture: Picture) -> bytes:
    """The bytes that ``payload_file`` stored."""
    size = int(picture.comment.split()[1])
    values = np.concatenate([c.blocks[: c.rows, : c.columns, 1:].reshape(-1) for c in picture.components])
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[:size]


def to_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes and media (binary) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, media = [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                media.append(payload_file(data + b"\xff" * (-len(data) % unit if data else unit)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with height, width and rgb (binary, row by row, full resolution); null where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            found = []
            for data in batch.column(column).to_pylist():
                try:
                    found.append(decode_file(data or b""))
                except (ValueError, IndexError, KeyError):
                    found.append(None)
            arrays = [pa.array([None if x is None else x.shape[i] for x in found], pa.int32()) for i in (0, 1)]
            arrays.append(pa.array([None if x is None else x.tobytes() for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, "height", "width", "rgb"])

    kept = [c for c in media.columns if c not in ("height", "width", "rgb")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in kept)
    return media.mapInArrow(run, f"{schema}, height int, width int, rgb binary")


def digests(media: DataFrame) -> DataFrame:
    """What was read back from files that ``to_media`` made, and a feature of the picture: its size, mean colours and the
    checksum of its tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out: list[tuple] = []
            for data in batch.column("media").to_pylist():
                picture = Picture(data)
                payload, rgb = payload_of(picture), picture.rgb()
                means = ",".join(f"{x:.3f}" for x in rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (rgb.size // 3))
                feature = f"{rgb.shape[1]}x{rgb.shape[0]}:{means}:{zlib.crc32(rgb):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(staged(to_media(table(spark, sf_dir, "documents")), "media"))
