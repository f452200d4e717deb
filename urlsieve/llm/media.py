"""Motion-JPEG AVI in a binary column: payloads stored losslessly, files parsed by their RIFF index, shots as clip rows.

A sample is one 8x8 block of one grey value: its DC coefficient, quantised by 8, holds the value less 128 exactly and all
its AC coefficients are zero, so that baseline JPEG keeps it without loss. A frame is 64 samples wide and up to ROWS high.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import slices, take_worker

#: Samples in a row of a frame, and rows in a frame at most.
WIDTH, ROWS = 64, 16
#: Microseconds that a frame is shown.
FRAME_US = 40_000
#: Frames coded at once; texts or files, and bytes of them, taken at once.
AT_ONCE, TEXTS, BYTES = 4096, 512, 1 << 21
#: Bytes of the largest file: what a cell of a binary column holds.
LARGEST = 2**31 - 1
#: Bins of a histogram; a cut is a change above this much and above the mean of the shot's changes by so many deviations.
BINS, LEAST_CHANGE, DEVIATIONS, MEMORY = 16, 0.25, 2.5, 8


def _code(diff: int) -> tuple[int, int]:
    """Bits and length for a DC difference and the end of its block: 4 bits of category, the value, a 0 bit."""
    size = abs(diff).bit_length()
    return (((size << size) | (diff if diff >= 0 else diff + (1 << size) - 1)) << 1, 5 + size)


CODES = np.array([_code(d)[0] for d in range(-255, 256)], np.uint64)
LENGTHS = np.array([_code(d)[1] for d in range(-255, 256)], np.int64)
DC_TABLE = bytes([0, 0, 0, 9, *[0] * 12]) + bytes(range(9))
AC_TABLE = bytes([1, *[0] * 15]) + b"\0"


def _jpeg_head(rows: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    return b"\xff\xd8" + part(0xDB, bytes([0, 8, *[1] * 63])) + part(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)) + part(0xC4, b"\x00" + DC_TABLE) + part(0xC4, b"\x10" + AC_TABLE) + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_frames(frames: list[bytes]) -> list[bytes]:
    """A JPEG image for each frame's samples; their number is WIDTH times the number of rows."""
    n = np.array([len(f) for f in frames], np.int64)
    x = np.frombuffer(b"".join(frames), np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    before = np.concatenate([[128], x[:-1]])
    before[first] = 128
    diff = x - before + 255
    size = LENGTHS[diff]
    ends = np.cumsum(size)
    bits = ends[first + n - 1] - (ends[first] - size[first])
    words = (bits + 63) // 64 + 1
    base = np.concatenate([[0], np.cumsum(words)[:-1]]) * 64
    at = ends - size + np.repeat(base - (ends[first] - size[first]), n)
    word, over = at >> 6, (at & 63) + size - 64
    code = CODES[diff]
    high = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros(int(words.sum()), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[starts]] = np.bitwise_or.reduceat(high, starts)
    split = np.flatnonzero(over > 0)
    out[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)
    length = (bits + 7) // 8
    data[base // 8 + length - 1] |= ((1 << (length * 8 - bits)) - 1).astype(np.uint8)
    heads: dict[int, bytes] = {}
    images = []
    for k, (s, m) in enumerate(zip((base // 8).tolist(), length.tolist(), strict=True)):
        rows = len(frames[k]) // WIDTH
        images.append(heads.setdefault(rows, _jpeg_head(rows)) + data[s : s + m].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return images


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a JPEG Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits: length of a block's code << 16 | its DC difference + 32768; 0 where it has AC coefficients."""
    end = [(c, n) for c, n, s in _table(ac[:16], ac[16:]) if s == 0]
    table = np.zeros(1 << 16, np.int64)
    for code, n, size in _table(dc[:16], dc[16:]):
        for bits in range(1 << size) if size <= 11 else ():
            diff = bits if not size or bits >> (size - 1) else bits - (1 << size) + 1
            total = n + size + end[0][1]
            if total <= 16:
                at = ((((code << size) | bits) << end[0][1]) | end[0][0]) << (16 - total)
                table[at : at + (1 << (16 - total))] = total << 16 | (diff + 32768)
    return table


_lookups: dict[tuple[bytes, bytes], np.ndarray] = {}


@dataclass
class Image:
    width: int
    height: int
    scale: int
    tables: tuple[bytes, bytes]
    data: bytes


#: The standard's tables, which motion-JPEG frames may leave out: by class and number.
STANDARD = {
    0x00: bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)]),
    0x01: bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, *range(12)]),
    0x10: bytes.fromhex(
        "0002010303020403050504040000017d01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
    0x11: bytes.fromhex(
        "00020102040403040705040400010277000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
}
#: Where the k-th coefficient of a scan stands in its block.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_RESTART, _SCAN_END = re.compile(rb"\xff+[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse_jpeg(data: bytes) -> Image:
    """The parts of a baseline grey JPEG image of one scan without restarts; ValueError for others."""
    at, scale, size, tables = 2, 8, (0, 0), {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while at + 4 <= len(data):
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            if len(body) != 65 or body[0]:
                raise ValueError("not the one quantisation table of 8 bits")
            scale = body[1]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1 or body[8]:
                raise ValueError("not an 8-bit grey image")
            size = struct.unpack(">HH", body[1:5])
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline images are decoded")
        elif marker == 0xDD and any(body):
            raise ValueError("restarts")
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                tables[body[0]] = body[1:m]
                body = body[m:]
        elif marker == 0xDA:
            if body[2]:
                raise ValueError("not the first tables")
            end = data.rindex(b"\xff\xd9")
            if _SCAN_END.search(data, at).start() != end:
                raise ValueError("more than a scan")
            return Image(size[1], size[0], scale, (tables[0x00], tables[0x10]), data[at:end].replace(b"\xff\x00", b"\xff"))
    raise ValueError("no scan in the image")


@dataclass
class Component:
    wide: int
    high: int
    quant: int
    blocks: np.ndarray


_symbols: dict[bytes, list[int]] = {}


def _by_bits(table: bytes) -> list[int]:
    """By the next 16 bits: length of the code << 8 | its symbol; 0 for no code."""
    if table not in _symbols:
        found = np.zeros(1 << 16, np.int64)
        for code, n, symbol in _table(table[:16], table[16:]):
            found[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        _symbols[table] = found.tolist()
    return _symbols[table]


def _read_blocks(data: bytes, units: list[tuple[int, np.ndarray, list[int], list[int]]]) -> None:
    """Fills blocks (component, its 64 coefficients in the scan's order, DC and AC lookups) from one stretch without restarts."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\0" * 16, np.uint8).astype(np.int64)
    window, end, at, before = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist(), 8 * (len(raw) - 16), 0, {}
    for own, block, dc, ac in units:
        k = 0
        while k < 64:
            if at > end:
                raise ValueError("a frame is damaged")
            hit = (ac if k else dc)[(window[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
            if not hit:
                raise ValueError("a frame is damaged")
            at += hit >> 8
            size = hit & 15
            if k:
                if not size and hit & 0xFF != 0xF0:
                    break
                k += (hit >> 4) & 15
            elif hit & 0xFF > 11:
                raise ValueError("a frame is damaged")
            if k > 63:
                raise ValueError("a frame is damaged")
            value = 0
            if size:
                bits = ((window[at >> 3] >> (16 - (at & 7))) & 0xFFFF) >> (16 - size) if at <= end else 0
                value = bits if bits >> (size - 1) else bits - (1 << size) + 1
                at += size
            if k == 0:
                before[own] = value = before.get(own, 0) + value
            block[k] = value
            k += 1
    if at > end:
        raise ValueError("a frame is damaged")


def _planes(data: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]], tuple[int, int], int | None, bytes]:
    """Planes of a baseline image as they are coded, their sampling factors, (height, width), Adobe's transform and component names."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    quant, tables, parts, size, restart, adobe, names, factors, seen, at = {}, dict(STANDARD), [], (0, 0), 0, None, b"", [], set(), 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a frame is damaged")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise ValueError("a frame is damaged")
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only images of 8 bits are decoded")
            size = struct.unpack(">HH", body[1:5])
            names, factors = body[6::3], [(x >> 4, x & 15) for x in body[7::3]]
            if len(factors) not in (1, 3) or not size[0] or not size[1] or not all(h and v for h, v in factors):
                raise ValueError("only images of one or three components are decoded")
            if len(factors) == 1:
                factors = [(1, 1)]
            top, low = max(h for h, _ in factors), max(v for _, v in factors)
            across, down = -(-size[1] // (8 * top)), -(-size[0] // (8 * low))
            for (h, v), q in zip(factors, body[8::3], strict=True):
                parts.append(Component(-(-size[1] * h // top), -(-size[0] * v // low), q, np.zeros((down * v, across * h, 64), np.int64)))
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images are decoded")
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                tables[body[0]] = body[1:m]
                body = body[m:]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            own = [(names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            looks = {c: (_by_bits(tables[t >> 4]), _by_bits(tables[0x10 | t & 15])) for c, t in own}
            stop = _SCAN_END.search(data, at)
            if not stop:
                raise ValueError("a frame is cut off")
            stretches = _RESTART.split(data[at : stop.start()])
            at = stop.start()
            if len(own) == 1:
                c = own[0][0]
                units = [[(c, b, *looks[c])] for line in parts[c].blocks[: -(-parts[c].high // 8)] for b in line[: -(-parts[c].wide // 8)]]
            else:
                units = [[(c, parts[c].blocks[y * factors[c][1] + j, x * factors[c][0] + i], *looks[c]) for c, _ in own for j in range(factors[c][1]) for i in range(factors[c][0])] for y in range(down) for x in range(across)]
            step = restart or len(units)
            if len(stretches) != -(-len(units) // step):
                raise ValueError("a frame is damaged")
            for k, stretch in enumerate(stretches):
                _read_blocks(stretch, [u for unit in units[k * step : (k + 1) * step] for u in unit])
            seen.update(c for c, _ in own)
    if not parts or len(seen) != len(parts):
        raise ValueError("no scan in the image")
    out = []
    for p in parts:
        flat = np.zeros(p.blocks.shape, np.float64)
        flat[..., ZIGZAG] = p.blocks * quant[p.quant]
        pixels = np.einsum("ux,yzuv,vw->yxzw", _COSINES, flat.reshape(*flat.shape[:2], 8, 8), _COSINES, optimize=True)
        high, wide = flat.shape[0] * 8, flat.shape[1] * 8
        out.append(np.clip(np.rint(pixels.reshape(high, wide) + 128), 0, 255).astype(np.uint8))
    return out, factors, size, adobe, names


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of a baseline JPEG image, (height, width) if grey, else (height, width, 3) in RGB; chroma is repeated, not smoothed."""
    planes, factors, (high, wide), adobe, names = _planes(data)
    top, low = max(h for h, _ in factors), max(v for _, v in factors)
    full = []
    for p, (h, v) in zip(planes, factors, strict=True):
        rows, columns = np.arange(high) * v // low, np.arange(wide) * h // top
        full.append(p[rows[:, None], columns[None, :]])
    if len(full) == 1:
        return full[0]
    if adobe == 0 or adobe is None and names == b"RGB":
        return np.stack(full, axis=2)
    y, cb, cr = full[0].astype(np.float64), full[1] - 128.0, full[2] - 128.0
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)


def grey_values(data: bytes) -> np.ndarray:
    """The brightness of each pixel of a baseline JPEG image, row by row."""
    pixels = decode_image(data)
    return pixels.ravel() if pixels.ndim == 2 else np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8).ravel()


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """The samples of each image whose blocks are flat, decoded side by side, a block of every image at a time.

    Of any other baseline image, the brightness of each pixel.
    """
    parsed: list[Image | None] = []
    for x in images:
        try:
            parsed.append(parse_jpeg(x))
        except (ValueError, IndexError, KeyError, AttributeError):
            parsed.append(None)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(parsed)
    kinds: dict[tuple, list[int]] = {}
    for k, p in enumerate(parsed):
        if p is None or not p.scale or not p.width or not p.height:
            out[k] = grey_values(images[k])
        else:
            kinds.setdefault((p.tables, p.scale), []).append(k)
    for (tables, scale), own in kinds.items():
        if tables not in _lookups:
            _lookups[tables] = _lookup(*tables)
        table = _lookups[tables]
        blocks = np.array([(parsed[k].width + 7) // 8 * ((parsed[k].height + 7) // 8) for k in own], np.int64)
        order = np.argsort(-blocks, kind="stable")
        own, blocks = [own[i] for i in order], blocks[order]
        starts = np.cumsum([0] + [len(parsed[k].data) + 4 for k in own])
        raw = np.frombuffer(b"".join(parsed[k].data + b"\0\0\0\0" for k in own), np.uint8).astype(np.int64)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at, value = starts[:-1] * 8, np.full(len(own), 128 * 8 // scale, np.int64)
        samples, other = np.zeros((int(blocks[0]), len(own)), np.uint8), np.zeros(len(own), bool)
        live = np.searchsorted(-blocks, -np.arange(1, blocks[0] + 1), side="right")
        for step, m in enumerate(live.tolist()):
            p = np.minimum(at[:m], 8 * len(window) - 8)
            hit = table[(window[p >> 3] >> (8 - (p & 7))) & 0xFFFF]
            if not hit.all():
                other[:m] |= hit == 0
                if other[:m].all():
                    break
            at[:m] += hit >> 16
            value[:m] += (hit & 0xFFFF) - 32768
            samples[step, :m] = value[:m] * scale // 8
        other |= (at + 7) // 8 != starts[1:] - 4
        rows = np.ascontiguousarray(samples.T)
        for k, row, n, full in zip(own, rows, blocks.tolist(), other.tolist(), strict=True):
            out[k] = grey_values(images[k]) if full else row[:n]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(images: list[bytes], rows: int, payload: int) -> bytes:
    """An AVI file of these frames, with an index and a chunk of our own that holds the payload's length."""
    wide, high = WIDTH * 8, rows * 8
    avih = struct.pack("<14I", FRAME_US, 0, 0, 0x10, len(images), 0, 1, max(map(len, images)), wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(images), max(map(len, images)), 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 8, b"MJPG", wide * high, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    parts, index, at = [b"movi"], [], 4
    for x in images:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(x)))
        parts.append(_chunk(b"00dc", x))
        at += len(parts[-1])
    body = b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", payload)) + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    if len(body) + 9 > LARGEST:
        raise ValueError("the file is too large for a cell of a binary column")
    return _chunk(b"RIFF", body)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of WIDTH."""
    cut = []
    for p in payloads:
        n = min(ROWS, len(p) // WIDTH) * WIDTH
        cut.append([p[k : k + n].ljust(n, b"\0") for k in range(0, len(p), n)])
    flat = [f for frames in cut for f in frames]
    images = [x for k in range(0, len(flat), AT_ONCE) for x in encode_frames(flat[k : k + AT_ONCE])]
    out, at = [], 0
    for p, frames in zip(payloads, cut, strict=True):
        out.append(write_avi(images[at : at + len(frames)], len(frames[0]) // WIDTH, len(p)))
        at += len(frames)
    return out


@dataclass
class Movie:
    frame_us: int
    payload: int | None
    frames: list[bytes]


def parse_avi(data: bytes) -> Movie:
    """A motion-JPEG AVI file's frames by its index, or in the order of their chunks if it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frame_us, payload, movi, index = 0, None, None, None
    stack = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    chunks = []
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                if kind != b"movi" or index is None:
                    stack.append((at + 12, at + 8 + n))
            elif name == b"avih":
                frame_us = int.from_bytes(data[at + 8 : at + 12], "little")
            elif name == b"plen":
                payload = int.from_bytes(data[at + 8 : at + 16], "little")
            elif name == b"idx1":
                index = at + 8, n
            elif name[2:] in (b"dc", b"db"):
                chunks.append((at, n))
            at += 8 + n + n % 2
    if movi is None:
        raise ValueError("no frames in the AVI file")
    if index:
        chunks = []
        for k in range(index[0], index[0] + index[1] // 16 * 16, 16):
            if data[k + 2 : k + 4] in (b"dc", b"db"):
                at, n = struct.unpack("<II", data[k + 8 : k + 16])
                at += movi if data[movi + at : movi + at + 4] == data[k : k + 4] else 0
                chunks.append((at, n))
    return Movie(frame_us, payload, [data[at + 8 : at + 8 + n] for at, n in chunks])


def decode_movies(files: list[bytes]) -> list[tuple[Movie, list[np.ndarray]]]:
    movies = [parse_avi(x) for x in files]
    flat = [f for m in movies for f in m.frames]
    samples = [x for k in range(0, len(flat), AT_ONCE) for x in decode_frames(flat[k : k + AT_ONCE])]
    out, at = [], 0
    for m in movies:
        out.append((m, samples[at : at + len(m.frames)]))
        at += len(m.frames)
    return out


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """[first, last] frames of each shot: a cut is a change of histogram that stands out from the shot's last ones."""
    if not frames:
        return []
    width = max(map(len, frames))
    hist = np.stack([np.bincount(f >> 4, minlength=BINS) / max(1, len(f)) for f in frames]) if width else np.zeros((len(frames), BINS))
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    out, first, seen = [], 0, []
    for k, c in enumerate(change.tolist(), 1):
        recent = seen[-MEMORY:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if c > max(LEAST_CHANGE, mean + DEVIATIONS * spread):
            out.append((first, k - 1))
            first, seen = k, []
        else:
            seen.append(c)
    return [*out, (first, len(frames) - 1)]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text as UTF-8, with bytes 0 up to a positive multiple of WIDTH, as an AVI file.

    A null text is stored as an empty one, WIDTH bytes 0. A row per row, equal texts to equal files; an empty table gives no
    rows; extra columns are ignored. A text whose file would be over 2 GB, which no cell holds, raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                media = encode_payloads([r.ljust(max(1, -(-len(r) // WIDTH)) * WIDTH, b"\0") for r in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, clip, first_frame, last_frame, start_ms, end_ms, error): a row per shot of each AVI file.

    A null or damaged file, or one whose frames aren't grey or three-component baseline JPEG, gives one row with error set.
    Repeated rows each give theirs, a file without frames and an empty table none. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        kind = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("error", pa.string())])
        for batch in batches:
            out = []
            for doc, data in (x for part in slices(batch, 1, TEXTS, BYTES) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                try:
                    if data is None:
                        raise ValueError("no file")
                    movie, frames = decode_movies([data])[0]
                    out += [(doc, k, a, b, a * movie.frame_us // 1000, (b + 1) * movie.frame_us // 1000, None) for k, (a, b) in enumerate(shots(frames))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    out.append((doc, None, None, None, None, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_ms long, end_ms long, error string")


def digests(media: DataFrame) -> DataFrame:
    """What reading the stored files back gives: payload, sums of payload and file, and the shots as a string; a row per row.

    A null or damaged file has null in the columns of its payload, and `error: ` with the reason as its feature. Repeated
    rows each give theirs, an empty table none. Extra columns are ignored.
    """

    def told(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, "error: no file"
        try:
            movie, frames = decode_movies([data])[0]
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error: {e}"
        return read(data, movie, frames)

    def read(data: bytes, movie, frames) -> tuple:
        payload = b"".join(f.tobytes() for f in frames)[: movie.payload]
        cut = shots(frames)
        ms = movie.frame_us // 1000
        feature = f"frames={len(frames)};shots={len(cut)};" + ",".join(f"{a * ms}-{(b + 1) * ms}" for a, b in cut)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for part in slices(batch, 2, TEXTS, BYTES):
                files = part.column(2).to_pylist()
                try:
                    rows = [read(data, *found) for data, found in zip(files, decode_movies(files), strict=True)]
                except (TypeError, ValueError, IndexError, KeyError, struct.error):
                    # one of them can't be read: each by itself
                    rows = [told(data) for data in files]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
