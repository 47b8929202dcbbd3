"""Baseline JPEG to arrays: Huffman-coded frames of 8 bits, one or three components, any sampling factors, restart intervals, one or more scans.

Symbols are read one by one; dequantising, the inverse transform and upsampling are array operations over all blocks of a frame. Frames of
motion JPEG may leave out their Huffman tables, which are then those of the standard's examples. Progressive, lossless, arithmetic and 12-bit
frames raise ValueError, as do broken ones.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Fixed values of the format: numbers of codes of each length in the standard's example tables, and their symbols. AC symbols go on in
# ascending order after those listed.
DC_COUNTS = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
AC_COUNTS = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
AC_FIRST = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
)

_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """The place in a block, row by row, of each coefficient: anti-diagonals, each walked against the one before."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    out = 0.5 * np.cos((2 * n + 1) * k * np.pi / 16)
    out[0] /= np.sqrt(2)
    return out


ZIGZAG, COSINES = _zigzag(), _cosines()


def _lookup(counts: list[int] | bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the symbol and the length of the code they start with, as 32 * symbol + length; 0 where none does."""
    out = np.zeros(1 << 16, np.int32)
    at = k = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            width = 1 << (16 - length)
            out[at : at + width] = 32 * symbol + length
            at += width
        k += n
    if k != len(symbols) or at > 1 << 16:
        raise ValueError("a Huffman table that is none")
    return out.tolist()


_defaults: dict[tuple[int, int], list[int]] = {}


def _default_table(kind: int, number: int) -> list[int]:
    if (kind, number) not in _defaults:
        if number > 1:
            raise ValueError("no Huffman table")
        if kind == 0:
            symbols = bytes(range(12))
        else:
            valid = {0x00, 0xF0} | {16 * run + size for run in range(16) for size in range(1, 11)}
            symbols = AC_FIRST[number] + bytes(sorted(valid - set(AC_FIRST[number])))
        _defaults[kind, number] = _lookup((DC_COUNTS, AC_COUNTS)[kind][number], symbols)
    return _defaults[kind, number]


class _Component:
    def __init__(self, number: int, across: int, down: int, table: int) -> None:
        self.number, self.across, self.down, self.table = number, across, down, table
        self.coefficients = np.zeros((0, 0, 64), np.int32)
        self.columns = self.rows = 0  # blocks of the component itself, without those that fill up the last units


def _read_scan(part: bytes, order: list[tuple], previous: list[int]) -> None:
    """Reads the blocks of one restart interval. `order` has (component's place, coefficients of the block, DC table, AC table)."""
    data = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, np.uint8).astype(np.int64)
    words = ((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]).tolist()
    end = 8 * (len(data) - 4)
    at = 0
    for place, block, dc, ac in order:
        k = 0
        while k < 64:
            if at >= end:
                raise ValueError("a frame that ends early")
            entry = (dc if k == 0 else ac)[(words[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
            if not entry:
                raise ValueError("bits that are no code")
            at += entry & 31
            run, size = (entry >> 5) >> 4, (entry >> 5) & 15
            if k == 0:
                run, size = 0, entry >> 5
                if size > 11:
                    raise ValueError("not a frame of 8 bits")
            elif size == 0:
                if run != 15:
                    break
                k += 16
                continue
            value = 0
            if size:
                if at + size > end:
                    raise ValueError("a frame that ends early")
                value = ((words[at >> 3] >> (16 - (at & 7))) & 0xFFFF) >> (16 - size)
                at += size
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
            if k == 0:
                previous[place] += value
                block[0] = previous[place]
                k = 1
            else:
                k += run
                if k > 63:
                    raise ValueError("a block of more than 64 terms")
                block[k] = value
                k += 1


def _blocks_of(scan: list[tuple[_Component, list[int], list[int]]], units: tuple[int, int]) -> list[list[tuple]]:
    """The blocks of each unit of a scan in the order of their bits, by interleaved units where it has several components."""
    if len(scan) == 1:
        c, dc, ac = scan[0]
        return [[(0, c.coefficients[y, x], dc, ac)] for y in range(c.rows) for x in range(c.columns)]
    return [
        [(p, c.coefficients[uy * c.down + y, ux * c.across + x], dc, ac) for p, (c, dc, ac) in enumerate(scan) for y in range(c.down) for x in range(c.across)]
        for uy in range(units[1]) for ux in range(units[0])
    ]


def planes(data: bytes) -> list[np.ndarray]:
    """The components of a frame, each as rows and columns of 8-bit samples in the frame's full size."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, interval, width, height, widest, tallest = 2, 0, 0, 0, 1, 1
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], list[int]] = {}
    components: list[_Component] = []
    units = (0, 0)
    read = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a frame that ends early")
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                quantisers[number] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                if len(quantisers[number]) != 64:
                    raise ValueError("a short quantiser")
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                tables[body[k] >> 4, body[k] & 15] = _lookup(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width or len(body) != 6 + 3 * n:
                raise ValueError("not a frame of 8 bits with a size")
            components = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            if not components or any(not 1 <= f <= 4 for c in components for f in (c.across, c.down)):
                raise ValueError("sampling factors that are none")
            widest, tallest = max(c.across for c in components), max(c.down for c in components)
            units = (-(-width // (8 * widest)), -(-height // (8 * tallest)))
            for c in components:
                c.coefficients = np.zeros((units[1] * c.down, units[0] * c.across, 64), np.int32)
                c.columns, c.rows = -(-(-(-width * c.across // widest)) // 8), -(-(-(-height * c.down // tallest)) // 8)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            named = {c.number: c for c in components}
            scan = []
            for k in range(1, 1 + 2 * body[0], 2):
                if body[k] not in named:
                    raise ValueError("a scan of components that the frame has not")
                dc, ac = body[k + 1] >> 4, body[k + 1] & 15
                scan.append((named[body[k]], tables.get((0, dc)) or _default_table(0, dc), tables.get((1, ac)) or _default_table(1, ac)))
            found = _END.search(data, at)
            end = found.start() if found else len(data)
            parts = _RESTART.split(data[at:end])
            order = _blocks_of(scan, units)
            step = interval or len(order)
            if len(parts) < -(-len(order) // step):
                raise ValueError("a frame that ends early")
            for k, part in zip(range(0, len(order), step), parts, strict=False):
                _read_scan(part, [b for unit in order[k : k + step] for b in unit], [0] * len(scan))
            at = end
            read += len(scan)
    if not components or read < len(components):
        raise ValueError("a frame without all of its scans")
    return [_samples(c, quantisers, width, height, widest, tallest) for c in components]


def _samples(c: _Component, quantisers: dict[int, np.ndarray], width: int, height: int, widest: int, tallest: int) -> np.ndarray:
    if c.table not in quantisers:
        raise ValueError("no quantiser")
    rows, columns = c.coefficients.shape[:2]
    terms = np.zeros((rows * columns, 64))
    terms[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * quantisers[c.table]
    pixels = COSINES.T @ terms.reshape(-1, 8, 8) @ COSINES
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    plane = pixels.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    # a sample stands for all pixels that it covers
    y, x = np.arange(height) * c.down // tallest, np.arange(width) * c.across // widest
    return plane[y][:, x]


def grey(data: bytes) -> np.ndarray:
    """The brightness of a frame's pixels: its first component."""
    return planes(data)[0]


def colours(data: bytes) -> np.ndarray:
    """Rows, columns and red, green, blue of a frame of one or three components."""
    parts = planes(data)
    if len(parts) == 1:
        return np.repeat(parts[0][:, :, None], 3, axis=2)
    if len(parts) != 3:
        raise ValueError("not a frame of one or three components")
    y, b, r = (p.astype(np.float64) for p in parts)
    b, r = b - 128, r - 128
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)), 0, 255).astype(np.uint8)
