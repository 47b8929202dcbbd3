"""AVI motion-JPEG as a media column: writing, RIFF index parsing, intra-frame decoding and shot detection.

Frames are baseline JPEG, one grey component, and each 8x8 block carries one 8-bit sample as its level: with a DC quantiser of 8 and no
AC terms, level b decodes to exactly b in all 64 pixels, so any payload is stored losslessly. The DC code of category c has 9 - c bits
and is followed by c bits, so every difference takes 9 bits, and the end of block takes one: frames of fixed-width symbols, coded
and decoded by array operations. Other baseline frames are decoded by `jpeg`. Shots are cut where the difference of neighbouring frames' grey
histograms exceeds an adaptive threshold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmur.llm import jpeg
from murmur.llm.base import raw, table

UNIT = 64
#: Blocks in a row and rows in a full frame: 4096 samples a frame.
COLUMNS, ROWS = 64, 64
FPS = 25
BINS = 16
#: A cut needs a histogram difference over the mean of those before it in the shot by this many deviations, and over FLOOR.
DEVIATIONS, FLOOR = 3.0, 0.10

CLIP_SCHEMA = "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_level double, error string"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_clips int"


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference -255..255 (9 bits and the end-of-block bit), and the difference of each 9 bits."""
    code, back = np.zeros((511, 10), np.uint8), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        prefix = "1" * (8 - c) + "0"  # 9 - c bits
        bits = prefix + (f"{extra:0{c}b}" if c else "")
        code[d + 255, :9] = [int(x) for x in bits]
        back[int(bits, 2)] = d
    return code, back


CODE, BACK = _code_tables()


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _head(rows: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, COLUMNS * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))  # one code of each of 1 to 9 bits
    ac = _segment(0xC4, bytes([0x10, 1] + [0] * 15) + bytes([0]))  # end of block
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + dc + ac + scan


_heads: dict[int, bytes] = {}
#: Where a head has the frame's height: after the mark of the start, the quantiser, and five bytes of the frame's segment.
HEIGHT_AT = 2 + 69 + 5


def encode_frame(samples: np.ndarray) -> bytes:
    """A JPEG whose blocks have the given levels; a whole number of rows of COLUMNS samples."""
    rows = len(samples) // COLUMNS
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, prepend=np.int16(0))
    bits = CODE[diff + 255].reshape(-1)
    body = np.packbits(bits)
    if pad := -len(bits) % 8:
        body[-1] |= (1 << pad) - 1
    head = _heads.get(rows) or _heads.setdefault(rows, _head(rows))
    return head + body.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def decode_frame(data: bytes) -> np.ndarray:
    """The grey samples of a frame: a level a block if the frame begins as this file's do, else a level a pixel; ValueError if it is no baseline JPEG."""
    rows = int.from_bytes(data[HEIGHT_AT : HEIGHT_AT + 2], "big") // 8
    head = _heads.get(rows) or _heads.setdefault(rows, _head(rows))
    if rows and data.startswith(head):
        return _levels(data[len(head) :], rows * COLUMNS)
    return jpeg.grey(data).reshape(-1)


def _levels(coded: bytes, n: int) -> np.ndarray:
    """The levels of n blocks of ten bits each."""
    data = np.frombuffer(coded[:-2].replace(b"\xff\x00", b"\xff"), np.uint8)
    if 8 * len(data) < 10 * n:
        raise ValueError("a frame that ends early")
    bits = np.unpackbits(data, count=10 * n).reshape(n, 10)
    if bits[:, 9].any():
        raise ValueError("bits that are no code")
    symbol = (bits[:, 0].astype(np.uint16) << 8) | np.packbits(bits[:, 1:9], axis=1)[:, 0]
    return (np.cumsum(BACK[symbol], dtype=np.int32) + 128).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that hold payload (a positive multiple of UNIT bytes); a short last frame is filled with zeros."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    rows = min(ROWS, len(payload) // COLUMNS)
    size = rows * COLUMNS
    n = -(-len(payload) // size)
    samples = np.frombuffer(payload + bytes(n * size - len(payload)), np.uint8)
    frames = [encode_frame(samples[k * size : (k + 1) * size]) for k in range(n)]
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, COLUMNS * 8, rows * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, COLUMNS * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, COLUMNS * 8, rows * 8, 1, 24, b"MJPG", COLUMNS * 8 * rows * 8 * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(data: bytes) -> dict:
    """The chunks that matter: frames as (offset, size) from the index, frame rate, size, and the payload's length (null in others' files).

    Frames are those of the first video stream. Offsets in an index may count from the list of frames or from the file's start; without a whole
    index, and in further RIFF segments, frames are found by walking the lists themselves.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"movi": [], "frames": [], "payload": None, "fps": 0.0, "stream": None, "streams": 0}
    index: list[tuple[int, int]] = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            stop = min(at + 8 + size, end)
            if name in (b"LIST", b"RIFF"):
                if data[at + 8 : at + 12] == b"movi":
                    if stop < at + 8 + size:
                        raise ValueError("an AVI file that ends early")
                    out["movi"].append((at + 8, stop))
                else:
                    walk(at + 12, stop)
            elif name == b"avih":
                period = struct.unpack("<I", data[at + 8 : at + 12])[0]
                out["fps"] = 1e6 / period if period else 0.0
                out["width"], out["height"] = struct.unpack("<II", data[at + 40 : at + 48])
            elif name == b"strh":
                if data[at + 8 : at + 12] == b"vids" and out["stream"] is None:
                    out["stream"] = out["streams"]
                    scale, rate = struct.unpack("<II", data[at + 28 : at + 36])
                    if scale and rate and not out["fps"]:
                        out["fps"] = rate / scale
                out["streams"] += 1
            elif name == b"strd" and size == 8:
                out["payload"] = struct.unpack("<Q", data[at + 8 : at + 16])[0]
            elif name == b"idx1" and stop == at + 8 + size:
                index.append((at + 8, stop))
            at += 8 + size + (size & 1)

    try:
        walk(0, len(data))
    except struct.error as e:
        raise ValueError("an AVI file that ends early") from e
    kinds = tuple(b"%02d%s" % (out["stream"] or 0, k) for k in (b"dc", b"db"))
    for number, (start, end) in enumerate(out["movi"]):
        indexed = [struct.unpack("<4sIII", data[k : k + 16]) for k in range(index[0][0], index[0][1] - 15, 16)] if number == 0 and index else []
        of_video = [(offset, n) for kind, _, offset, n in indexed if kind in kinds]
        if of_video:
            base = start if data[start + of_video[0][0] : start + of_video[0][0] + 4] in kinds else 0
            out["frames"] += [(base + offset + 8, n) for offset, n in of_video]
        else:
            out["frames"] += _walked(data, start + 4, end, kinds)
    return out


def _walked(data: bytes, at: int, end: int, kinds: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a list without an index, in its groups of records too."""
    out = []
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"LIST":
            at += 12
            continue
        if name in kinds:
            out.append((at + 8, size))
        at += 8 + size + (size & 1)
    return out


def read_frames(data: bytes) -> tuple[dict, list[np.ndarray]]:
    """What parse_avi gives, and the grey samples of each frame; an empty chunk shows the frame before it again."""
    info = parse_avi(data)
    frames: list[np.ndarray] = []
    for at, n in info["frames"]:
        if at + n > len(data):
            raise ValueError("an AVI file that ends early")
        if n:
            frames.append(decode_frame(data[at : at + n]))
        elif frames:
            frames.append(frames[-1])
    return info, frames


def read_payload(data: bytes) -> bytes:
    info, frames = read_frames(data)
    if info["payload"] is None:
        raise ValueError("not a file of write_avi")
    return np.concatenate(frames).tobytes()[: info["payload"]]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """Shots as [first, end) frame numbers: cut where a histogram difference is far above those of the shot so far."""
    if not frames:
        return []
    hist = [np.bincount(f >> 4, minlength=BINS) / len(f) for f in frames]
    cuts, seen = [0], []
    for k in range(1, len(frames)):
        d = 0.5 * float(np.abs(hist[k] - hist[k - 1]).sum())
        mean = sum(seen) / len(seen) if seen else 0.0
        spread = (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5 if seen else 0.0
        if d > max(FLOOR, mean + DEVIATIONS * spread):
            cuts.append(k)
            seen = []
        else:
            seen.append(d)
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))


def clips(data: bytes) -> list[tuple[int, int, int, float, float, float]]:
    """Timed clips of an AVI file: number, first frame, frames, start and end in seconds, mean level."""
    info, frames = read_frames(data)
    return _clips(info, frames)


def _clips(info: dict, frames: list[np.ndarray]) -> list[tuple[int, int, int, float, float, float]]:
    fps = info["fps"] or FPS
    return [(k, a, b - a, a / fps, b / fps, float(np.mean([f.mean() for f in frames[a:b]]))) for k, (a, b) in enumerate(shots(frames))]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT) if data else bytes(UNIT)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        whole = data.tobytes()
        yield batch.column("doc_id").to_pylist(), [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("n_clips", pa.int32())])
    for ids, texts in _texts(batches):
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            media = write_avi(padded(text))
            info, frames = read_frames(media)
            payload = (frames[0] if len(frames) == 1 else np.concatenate(frames)).tobytes()[: info["payload"]]
            found = _clips(info, frames)
            feature = ";".join(f"{start:.2f}-{end:.2f}:{level:.3f}" for _, _, _, start, end, level in found)
            rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), len(found)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in CLIP_SCHEMA.split(", ")]
    for batch in batches:
        for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if not media:
                continue
            try:
                found = [(doc_id, *c, None) for c in clips(media)]
            except (ValueError, struct.error, IndexError) as e:
                found = [(doc_id, *[None] * 6, str(e) or type(e).__name__)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        for doc_id, text in zip(ids, texts, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([write_avi(padded(text))], pa.binary())], names=["doc_id", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file. A null text is an empty one, stored as 64 zero bytes; repeated rows each get a file, further columns are left out."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_media, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clip rows of a column of AVI files of motion JPEG, this file's or others'; doc_id and media, further columns are left out.

    None for null or empty files and for those without frames; a row with only doc_id and error for a file that can't be read (not AVI, cut off,
    not baseline JPEG). Repeated rows each give theirs. A file is read in one task: memory is a few times its decoded frames.
    """
    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(_clip_rows, CLIP_SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as AVI and read back: lengths, digests and the clips as text. 

    One row per row, repeated ones and those without doc_id included; a null or empty text has a payload of 64 zeros; long texts have more
    frames; an empty table gives none; further columns, whatever their names, are left out.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_digests, DIGEST_SCHEMA)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
