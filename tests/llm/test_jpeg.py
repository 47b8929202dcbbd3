"""Frames and files of other writers, compared with the Java image library and with a plain inverse transform."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest

from murmur.llm import jpeg, media


def java_jpeg(spark, pixels: np.ndarray) -> bytes:
    """Pixels (rows, columns and colours, or rows and columns) as the Java image library writes them."""
    jvm = spark._jvm
    height, width = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if pixels.ndim == 3 else 10)
    for y in range(height):
        for x in range(width):
            if pixels.ndim == 3:
                r, g, b = (int(v) for v in pixels[y, x])
                image.setRGB(x, y, r << 16 | g << 8 | b)
            else:
                image.getRaster().setSample(x, y, 0, int(pixels[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def java_pixels(spark, data: bytes) -> np.ndarray:
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
    grid = [[image.getRGB(x, y) & 0xFFFFFF for x in range(image.getWidth())] for y in range(image.getHeight())]
    return np.array([[(v >> 16, v >> 8 & 255, v & 255) for v in row] for row in grid])


def picture(height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    return np.stack([(3 * x + y) % 256, 128 + 100 * np.sin(x / 9), (255 - 2 * y) % 256], axis=2).astype(np.uint8)


@pytest.mark.parametrize(("height", "width"), [(16, 16), (19, 27), (5, 40)])
def test_frames_of_another_writer(spark, height, width):
    grey = picture(height, width)[:, :, 0]
    data = java_jpeg(spark, grey)
    raster = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    want = np.array([[raster.getSample(x, y, 0) for x in range(width)] for y in range(height)])
    assert np.abs(jpeg.grey(data).astype(int) - want).max() <= 1
    data = java_jpeg(spark, picture(height, width))
    got, want = jpeg.colours(data).astype(int), java_pixels(spark, data)
    assert got.shape == want.shape
    bright = np.array([0.299, 0.587, 0.114])
    # brightness is exact up to rounding and clipping; that library smooths the halved colour planes
    assert np.abs(got @ bright - want @ bright).mean() < 2 and np.abs(got - want).mean() < 8


def plain_encode(blocks: list[list[int]], interval: int, tables: bool) -> bytes:
    """A row of grey blocks given as quantised terms in zigzag order, coded bit by bit with the example tables."""

    def codes(counts, symbols):
        out, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[symbols[k]] = f"{code:0{length}b}"
                code, k = code + 1, k + 1
            code <<= 1
        return out

    ac_symbols = list(jpeg.AC_FIRST[0])
    ac_symbols += [s for s in range(256) if ((1 <= s & 15 <= 10) or s in (0, 0xF0)) and s not in ac_symbols]
    dc, ac = codes(jpeg.DC_COUNTS[0], list(range(12))), codes(jpeg.AC_COUNTS[0], ac_symbols)

    def amount(v):
        size = abs(v).bit_length()
        return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    parts = []
    for start in range(0, len(blocks), interval):
        bits, before = "", 0
        for block in blocks[start : start + interval]:
            size, extra = amount(block[0] - before)
            before = block[0]
            bits += dc[size] + extra
            run = 0
            for v in block[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + ac[0xF0], run - 16
                size, extra = amount(v)
                bits += ac[16 * run + size] + extra
                run = 0
            bits += ac[0] if run else ""
        bits += "1" * (-len(bits) % 8)
        parts.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xDB, bytes([0, *range(1, 65)])) + segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(blocks), 1) + bytes([1, 0x11, 0]))
    if tables:
        out += segment(0xC4, bytes([0, *jpeg.DC_COUNTS[0], *range(12)])) + segment(0xC4, bytes([0x10, *jpeg.AC_COUNTS[0], *ac_symbols]))
    out += segment(0xDD, struct.pack(">H", interval)) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    body = parts[0]
    for k, part in enumerate(parts[1:]):
        body += bytes([0xFF, 0xD0 + k % 8]) + part
    return out + body + b"\xff\xd9"


def plain_pixels(block: list[int]) -> list[list[float]]:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    terms = {cell: v * (k + 1) for k, (cell, v) in enumerate(zip(cells, block, strict=True))}
    scale = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    wave = lambda n, k: math.cos((2 * n + 1) * k * math.pi / 16)
    return [[128 + sum(v * scale(r) * scale(c) * wave(y, r) * wave(x, c) for (r, c), v in terms.items()) / 4 for x in range(8)] for y in range(8)]


@pytest.mark.parametrize("tables", [True, False])
def test_intervals_long_runs_and_example_tables(tables):
    rng = np.random.default_rng(5)
    blocks = []
    for k in range(21):
        block = [int(rng.integers(-200, 200))] + [0] * 63
        for place in rng.integers(1, 64, k % 5):
            block[place] = int(rng.integers(-6, 7))
        block[63] = k % 3 - 1
        blocks.append(block)
    got = jpeg.grey(plain_encode(blocks, 4, tables))
    want = np.concatenate([np.array(plain_pixels(b)) for b in blocks], axis=1)
    assert got.shape == (8, 168) and np.abs(got - np.clip(want, 0, 255)).max() <= 0.51


def test_broken_frames_raise(spark):
    whole = plain_encode([[5] + [0] * 62 + [1]] * 6, 3, True)
    for cut in range(2, len(whole) - 3, 7):
        with pytest.raises((ValueError, struct.error)):
            jpeg.grey(whole[:cut])
    with pytest.raises(ValueError):
        jpeg.grey(whole.replace(b"\xff\xc0", b"\xff\xc2"))


def avi(frames: list[bytes], index: bool, absolute: bool, groups: bool) -> bytes:
    """A file with sound before the pictures in each record, as other writers make them."""
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    strh = lambda kind: chunk(b"strh", kind + struct.pack("<IHHIIIIIIII4H", *[0] * 15))
    hdrl = chunk(b"avih", struct.pack("<14I", 40_000, 0, 0, 0x10, len(frames), 0, 2, 0, 8, 8, 0, 0, 0, 0))
    hdrl += chunk(b"LIST", b"strl" + strh(b"auds\0\0\0\0")) + chunk(b"LIST", b"strl" + strh(b"vidsMJPG"))
    head = b"AVI " + chunk(b"LIST", b"hdrl" + hdrl) + chunk(b"JUNK", b"abc")
    movi, places = b"movi", []
    for f in frames:
        sound = chunk(b"00wb", b"xyz")
        if groups:
            movi += b"LIST" + struct.pack("<I", 4 + len(sound) + len(chunk(b"01dc", f))) + b"rec "
        places.append((b"00wb", len(movi), 3))
        movi += sound
        places.append((b"01dc", len(movi), len(f)))
        movi += chunk(b"01dc", f)
    shift = 8 + len(head) + 8 if absolute else 0
    body = head + chunk(b"LIST", movi)
    if index:
        body += chunk(b"idx1", b"".join(struct.pack("<4sIII", kind, 0x10, at + shift, n) for kind, at, n in places))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_files_of_other_writers(spark):
    dark, light = (plain_encode([[level] + [0] * 63] * 2, 2, True) for level in (-800, 700))
    rows = [(k, bytearray(avi([dark, dark, b"", light, light], *how))) for k, how in enumerate([(True, False, False), (True, True, False), (False, False, False), (False, False, True)])]
    rows.append((4, rows[0][1][:-100]))  # its index is cut off
    rows += [(9, bytearray(b"RIFFxxxx")), (10, bytearray()), (11, None), (12, bytearray(rows[0][1][:-300])), (13, bytearray(avi([dark, b"no frame"], True, False, False)))]
    got = media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    for k in range(5):
        assert [(r.first_frame, r.n_frames, r.start_s, r.error) for r in got if r.doc_id == k] == [(0, 3, 0.0, None), (3, 2, 0.12, None)]
    assert {r.doc_id: r.clip for r in got if r.error} == {9: None, 12: None, 13: None}
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 9, 12, 13}


def plain_feature(payload: bytes) -> str:
    """Clips of the stored levels, frame by frame: start and end in seconds and mean level."""
    size = min(4096, len(payload) // 64 * 64)
    payload += bytes(-len(payload) % size)
    frames = [payload[k : k + size] for k in range(0, len(payload), size)]
    share = [[sum(v // 16 == b for v in f) / size for b in range(16)] for f in frames]
    clips, seen = [[0]], []
    for k in range(1, len(frames)):
        apart = sum(abs(x - y) for x, y in zip(share[k], share[k - 1], strict=True)) / 2
        mean = sum(seen) / len(seen) if seen else 0.0
        spread = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen)) if seen else 0.0
        if apart > max(0.1, mean + 3 * spread):
            clips.append([])
            seen = []
        else:
            seen.append(apart)
        clips[-1].append(k)
    level = lambda part: sum(sum(frames[k]) / size for k in part) / len(part)
    return ";".join(f"{part[0] / 25:.2f}-{(part[-1] + 1) / 25:.2f}:{level(part):.3f}" for part in clips)


def test_features_equal_a_plain_version(spark):
    long = "".join(c * 4096 * n for c, n in (("a", 3), ("é", 2), ("~", 1), ("0", 4))) + "abc ~é" * 3000
    texts = [None, "", "x", "a" * 64, long, "word " * 5000]
    got = {r.doc_id: r for r in media.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k].feature == plain_feature(media.padded((t or "").encode())), k
    assert got[4].n_clips > 3
