"""Repeated passages by the common-prefix interval tree of an enhanced suffix array.

A stack scan of a suffix array's longest common prefixes gives its intervals: sets of suffixes that share a prefix. Those whose occurrences
follow different bytes (or a text's start) are maximal repeats, with all their occurrences. The operator removes each byte that a string
of `least` bytes covers which also starts in a document with a smaller doc_id.

Distribution: a string of `least` bytes has a minimizer, the window of GRAM bytes in it with the smallest hash, which depends on its
content alone. A text falls into runs of neighbouring strings with the same minimizer; runs are dealt by the minimizer's hash, so equal
strings of any two documents meet in one bucket, which has its own suffix array, interval tree and groups. Hashes only bring strings
together; that they are equal is confirmed on their bytes. First a pass over hashes alone finds minimizers of
at least two documents (a bit filter of bounded size); only their runs are moved. A run that repeats within a task's block is resolved
there: only its smallest document's is moved, so a passage of a third of all documents doesn't gather in one bucket.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import kernels as K
from murmur.llm.base import partitions, pieces, raw, table

LEAST = 50
GRAM = 16
#: Texts longer than this are cut into segments, overlapping so that each string lies in one.
SEGMENT = 4 << 20
#: Bytes of runs that a task holds before it deals them out.
BLOCK = 12 << 20
#: Bytes of text for each bucket, and for each bit of the filter; bounds of the filter's bits.
BUCKET_BYTES = 2 << 20
BIT_BYTES, BITS_MIN, BITS_MAX = 16, 20, 30

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- the interval tree ---------------------------------------------------------------------------------------------------------------


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of a suffix array with a common prefix of at least `least`, inner ones first.

    lcp[i] is the longest common prefix of suffixes i - 1 and i; lcp[0] is not used.
    """
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        left = i - 1
        while stack and stack[-1][0] > h:
            length, left = stack.pop()
            yield length, left, i - 1
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, left))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of an array of numbers in order, by prefix doubling."""
    n = len(data)
    rank = data.astype(np.int64) + 1
    k = 1
    order = np.argsort(rank, kind="stable")
    while n and k < 2 * n:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.ones(n, np.int64)
        new[1:] += np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            break
        k *= 2
    return order


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All maximal repeats of at least `least` bytes of a block of texts, with all occurrences (text number, start). Matches never cross texts."""
    # each text ends in a value of its own, below all bytes, so no two suffixes are equal beyond a text's end
    parts = [np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), k) for k, t in enumerate(texts)]
    start = np.cumsum([0, *map(len, parts)])
    data = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = suffix_array(data)
    of = np.searchsorted(start, order, side="right") - 1
    lcp = [0] * len(order)
    for i in range(1, len(order)):
        a, b = int(order[i - 1]), int(order[i])
        m = int(min(start[of[i - 1] + 1] - a, start[of[i] + 1] - b))
        same = data[a : a + m] == data[b : b + m]
        lcp[i] = m if same.all() else int(np.argmin(same))
    out = []
    for length, lo, hi in intervals(lcp, least):
        at = [(int(of[i]), int(order[i] - start[of[i]])) for i in range(lo, hi + 1)]
        left = {data[order[i] - 1] if p else (t,) for i, (t, p) in zip(range(lo, hi + 1), at, strict=True)}
        if len(left) > 1 or any(not p for _, p in at):
            out.append((texts[at[0][0]][at[0][1] : at[0][1] + length], sorted(at)))
    return out


# --- runs of strings with one minimizer ----------------------------------------------------------------------------------------------


def runs(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string starts of each run, and the minimizer's hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none.astype(np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    size = n - gram + 1
    h = eight[:size] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in range(8, gram, 8):
        h = (h + eight[min(k, gram - 8) : min(k, gram - 8) + size]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    width, span = least - gram + 1, 1
    while 2 * span <= width:  # least of `span` neighbours, twice as many each time
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    # strings that end in their row
    ends = np.zeros(n + 1, np.int32)
    lo = np.maximum(offsets[:-1], offsets[1:] - least + 1)
    np.add.at(ends, lo, 1)
    np.add.at(ends, offsets[1:], -1)
    at = np.flatnonzero(np.cumsum(ends[: len(h)]) == 0)
    if not len(at):
        return none, none, none.astype(np.uint64)
    m = h[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    place = (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = eight[place]
    for k in range(8, gram, 8):
        own = K.mix(own) + eight[place + min(k, gram - 8)]
    return at[first], at[last], K.mix(own)


def identity(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of each row's text: with the doc_id it names a row, and rows that share both lose the same bytes."""
    whole = data.tobytes()
    return np.frombuffer(b"".join([hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]), "<i8")


def segments(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Doc ids, identities, bytes, offsets and the place of the first byte in its text."""
    for part, data, offsets in pieces(batch, "text"):
        ids, own = part.column("doc_id").to_numpy(), identity(data, offsets)
        if len(ids) > 1 or len(data) <= SEGMENT:
            yield ids, own, data, offsets, 0
            continue
        for a in range(0, len(data) - least + 1, SEGMENT):
            cut = data[a : a + SEGMENT + least - 1]
            yield ids, own, cut, np.array([0, len(cut)]), a


class Filter:
    """Bits of the minimizers that at least two documents have; parts of it are made by separate tasks."""

    def __init__(self, total: int):
        self.bits = min(BITS_MAX, max(BITS_MIN, (max(1, total) // BIT_BYTES).bit_length()))
        self.part_bits = min(self.bits - 6, max(8, (max(1, total) // (8 << 20)).bit_length()))
        self.data: np.ndarray | None = None

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def build(self, docs: DataFrame, least: int, gram: int) -> None:
        """Two passes of hashes: each task's distinct minimizers, 5 bytes each, dealt by their upper bits; then the bits of the repeated ones."""
        part_bits, place = self.part_bits, self.place

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def out() -> pa.RecordBatch:
                h = np.sort(np.concatenate(held))  # once for each document that has it
                new = np.concatenate([[True], h[1:] != h[:-1]])
                twice = np.zeros(len(h), np.uint64)
                twice[:-1] = h[1:] == h[:-1]
                h, twice = h[new], twice[new]
                part = (h >> np.uint64(64 - part_bits)).astype(np.int64)
                # the next 39 bits and whether two documents of this block have it
                low = ((h << np.uint64(part_bits)) >> np.uint64(25) << np.uint64(1)) | twice
                body = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                cut = np.searchsorted(part, np.arange((1 << part_bits) + 1))
                some = np.flatnonzero(np.diff(cut))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([body[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "body"])

            size = 0
            for batch in batches:
                for _, _, data, offsets, _ in segments(batch, least):
                    first, _, h = runs(data, offsets, least, gram)
                    row = np.searchsorted(offsets, first, side="right")
                    own = np.argsort(K.mix(h ^ K.mix(row.astype(np.uint64))))
                    h, row = h[own], row[own]
                    keep = np.ones(len(h), bool)
                    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    held.append(h[keep])
                    size += len(held[-1])
                    if size > 1 << 20:
                        yield out()
                        size = 0
            if size:
                yield out()

        bits = self.bits

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def out() -> pa.RecordBatch:
                wide = np.zeros((sum(map(len, held)) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 5)
                low = np.sort(wide.view("<u8")[:, 0])
                h, twice = low >> np.uint64(1), (low & np.uint64(1)).astype(bool)
                again = np.zeros(len(h), bool)
                again[1:] = h[1:] == h[:-1]
                full = (np.uint64(at) << np.uint64(64 - part_bits)) | (h[again | twice] << np.uint64(25 - part_bits))
                own = place(full) - (at << (bits - part_bits))
                flags = np.zeros(1 << (bits - part_bits), np.uint8)
                flags[own] = 1
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(np.packbits(flags, bitorder="little").tobytes(), 1)], pa.binary())], names=["part", "bits"])

            for batch in batches:
                for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    if part != at and held:
                        yield out()
                        held = []
                    at = part
                    held.append(body)
            if held:
                yield out()

        n = partitions(docs.sparkSession)
        found = docs.mapInArrow(deal, "part int, body binary").repartition(n, "part").sortWithinPartitions("part").mapInArrow(find, "part int, bits binary")
        self.data = np.zeros(1 << (self.bits - 3), np.uint8)
        width = 1 << (self.bits - self.part_bits - 3)
        for r in found.toLocalIterator():  # 2**bits bits in all
            self.data[r.part * width : (r.part + 1) * width] = np.frombuffer(zstandard.decompress(bytes(r.bits)), np.uint8)


# --- dealing runs, finding repeats, removing them ----------------------------------------------------------------------------------------


def _home(own: np.ndarray, homes: int) -> np.ndarray:
    return (K.mix(own.view(np.uint64) + np.uint64(1)) % np.uint64(homes)).astype(np.int32)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    return data[np.repeat(start - first, size) + np.arange(int(size.sum()))]


def _cuts(values: np.ndarray) -> list[int]:
    """Where each run of equal values begins, and the end."""
    return [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]


def _spans(ids: np.ndarray, own: np.ndarray, start: np.ndarray, size: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """Spans as bytes for each home."""
    home = _home(own, homes)
    order = np.lexsort((start, own, ids, home))
    home, ids, own, start, size = home[order], ids[order], own[order], start[order], size[order]
    cut = _cuts(home)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        s = slice(lo, hi)
        yield int(home[lo]), b"".join([x[s].astype("<i8").tobytes() for x in (ids, own, start)]) + size[s].astype("<i4").tobytes()


def _read_spans(body: bytes) -> tuple[np.ndarray, ...]:
    n = len(body) // 28
    return *(np.frombuffer(body, "<i8", n, 8 * n * k) for k in range(3)), np.frombuffer(body, "<i4", n, 24 * n)


def _write_runs(ids: np.ndarray, own: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, text: np.ndarray) -> bytes:
    """Runs in the order of their rows: each row's ids once, then which runs begin a row, and their places, sizes, bytes before and bytes."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
    return b"".join([
        struct.pack("<II", len(ids), int(new.sum())), ids[new].astype("<i8").tobytes(), own[new].astype("<i8").tobytes(), new.astype(np.uint8).tobytes(),
        start.astype("<i8").tobytes(), size.astype("<u2").tobytes(), left.astype("<i2").tobytes(), text.tobytes(),
    ])


def _read_runs(body: bytes) -> tuple[np.ndarray, ...]:
    n, rows = struct.unpack_from("<II", body)
    at, out = 8, []
    for kind, m in (("<i8", rows), ("<i8", rows), (np.uint8, n), ("<i8", n), ("<u2", n), ("<i2", n), (np.uint8, -1)):
        out.append(np.frombuffer(body, kind, m, at))
        at += out[-1].nbytes
    row = np.cumsum(out[2], dtype=np.int64) - 1
    return out[0][row], out[1][row], out[3], out[4].astype(np.int64), out[5], out[6]


def deal_runs(docs: DataFrame, filter_: Filter, buckets: int, homes: int, least: int, gram: int, every: bool = False) -> DataFrame:
    """(bucket, home, body): the runs of each bucket (home null), or spans already known to be repeats. every: no run is resolved here."""
    bits, data_ = filter_.bits, filter_.data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_ = Filter(1)
        known_.bits, known_.data = bits, data_
        pack = zstandard.ZstdCompressor(level=3).compress
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, own, start, size, left, content, h = (np.concatenate([x[k] for x in held]) for k in range(7))
            text = np.concatenate([x[7] for x in held])
            held.clear()
            at = np.cumsum(size) - size
            rows, known = [], np.zeros(len(ids), bool)
            if not every:
                # equal runs, as their bytes say: only those of the smallest document are dealt
                order = np.lexsort((ids, content))
                x, y = order[:-1], order[1:]
                again = np.flatnonzero((content[x] == content[y]) & (size[x] == size[y]))
                new = np.ones(len(order), bool)
                new[again[K.equal(text, at[x[again]], at[y[again]], size[x[again]])] + 1] = False
                smallest = np.empty(len(ids), np.int64)
                smallest[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                known = ids > smallest
                rows = [(home % buckets, home, body) for home, body in _spans(ids[known], own[known], start[known], size[known], homes)]
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, own, ids, bucket))
            order = order[~known[order]]
            cut = _cuts(bucket[order])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                o = order[lo:hi]
                rows.append((int(bucket[o[0]]), None, pack(_write_runs(ids[o], own[o], start[o], size[o], left[o], _gather(text, at[o], size[o])))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "home", "body"])

        total = 0
        for batch in batches:
            for ids, own, data, offsets, base in segments(batch, least):
                first, last, h = runs(data, offsets, least, gram)
                some = known_.has(h)
                first, last, h = first[some], last[some], h[some]
                if not len(first):
                    continue
                row = np.searchsorted(offsets, first, side="right") - 1
                size = last - first + least
                before = np.where(first > offsets[row], data[first - 1].astype(np.int16), np.int16(-1 if not base else 256))
                content = K.Hashes(data).of(first, first + size)
                held.append((ids[row], own[row], first - offsets[row] + base, size, before, content, h, _gather(data, first, size)))
                total += int(size.sum())
                if total > BLOCK:
                    yield from out()
                    total = 0
        if held:
            yield from out()

    return docs.mapInArrow(run, "bucket int, home int, body binary")


def tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last of all intervals of at least `least`; stretches that are one interval need no stack."""
    edge = np.flatnonzero(np.concatenate([lcp < least, [True]]))
    lo, hi = edge[:-1], edge[1:] - 1
    many = hi > lo
    lo, hi = lo[many], hi[many]
    # whether all prefixes within the stretch are as long as the first
    change = np.concatenate([[0], np.cumsum(lcp[1:] != lcp[:-1])])
    plain = change[hi] == change[lo + 1]
    found = [(lcp[lo[plain] + 1], lo[plain], hi[plain])]
    rest = [(n, x + a, x + b) for x, y in zip(lo[~plain].tolist(), hi[~plain].tolist(), strict=True) for n, a, b in intervals(lcp[x : y + 1].tolist(), least)]
    if rest:
        found.append(tuple(np.array(c, np.int64) for c in zip(*rest, strict=True)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@dataclass
class Groups:
    """Maximal repeats of a bucket: lengths, and the members [first, last] of each among the suffixes, which are a run and a place in it each."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    run: np.ndarray
    nth: np.ndarray

    def members(self, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Group numbers and members, some groups at a time."""
        size = self.last - self.first + 1
        total, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, side="right")))
            n = size[lo:hi]
            group = np.repeat(np.arange(hi - lo), n)
            yield group + lo, self.first[lo:hi][group] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[group]
            lo = hi


def groups_of(ids: np.ndarray, own: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, text: np.ndarray, least: int) -> Groups:
    """The groups of a bucket's runs: intervals of its suffix array that have several documents and are left-diverse, or begin a run.

    A group that is not left-diverse is a longer group's, one byte further left, less its first byte.
    """
    none = np.zeros(0, np.int64)
    at = np.cumsum(size) - size
    n = size - least + 1
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    place = at[run] + nth
    h = K.Hashes(text).of(place, place + least)
    order = np.argsort(h)
    s = h[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    order = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
    if not len(order):
        return Groups(none, none, none, none, none)
    # strings of equal hashes that may begin a group; others are inside longer ones
    s = h[order]
    edge = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    width = np.diff(np.append(edge, len(s)))
    inner = nth[order] > 0
    before = np.where(inner, text[np.maximum(place[order] - 1, 0)], left[run[order]])
    doc = ids[run[order]]
    begins = (np.minimum.reduceat(inner, edge) == 0) | (np.minimum.reduceat(before, edge) != np.maximum.reduceat(before, edge)) | (np.minimum.reduceat(before, edge) < 0)
    begins &= np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
    take = np.repeat(begins, width)
    order, group = order[take], np.repeat(np.arange(len(edge)), width)[take]
    if not len(order):
        return Groups(none, none, none, none, none)
    # their suffix array: equal in the first `least` bytes within a group, so the rest of the run gives the order
    group = confirmed(group, place[order], text, least)
    rest = size[run[order]] - nth[order] - least
    most = int(rest.max())
    words = most // 8 + 1
    tail = np.zeros((len(order), 8 * words), np.uint8)
    for k in range(most):
        ok = rest > k
        tail[ok, k] = text[place[order[ok]] + least + k]
    keys = tail.view(">u8").astype(np.uint64)
    sa = np.lexsort((rest, *(keys[:, k] for k in range(words - 1, -1, -1)), group))  # of equal ones, padded with zeros, the shorter first
    order, group, rest, tail = order[sa], group[sa], rest[sa], tail[sa]
    differ = tail[1:] != tail[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 * words)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], least + np.minimum(same, np.minimum(rest[1:], rest[:-1])), 0)
    out = Groups(*tree(lcp, least), run[order], nth[order])
    if len(out.length):
        ends = np.stack([out.first, out.last + 1], axis=1).reshape(-1)
        over = lambda f, x: f.reduceat(np.append(x, x[-1]), ends)[::2]
        inner, doc = out.nth > 0, ids[out.run]
        before = np.where(inner, text[np.maximum(place[order] - 1, 0)], left[out.run])
        keep = (over(np.minimum, inner.astype(np.int8)) == 0) | (over(np.minimum, before) != over(np.maximum, before)) | (over(np.minimum, before) < 0)
        keep &= over(np.minimum, doc) < over(np.maximum, doc)
        out.length, out.first, out.last = out.length[keep], out.first[keep], out.last[keep]
    return out


def confirmed(group: np.ndarray, place: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Numbers of groups, parted where strings of `least` bytes with one number are not the same bytes."""
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    parts = [eight[place + k] for k in [*range(0, least - 7, 8), least - 8]]
    again = group[1:] == group[:-1]
    if all((p[1:] == p[:-1])[again].all() for p in parts):
        return group
    order = np.lexsort((*parts, group))
    new = np.zeros(len(order), bool)
    for x in (group, *parts):
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeats_of(ids: np.ndarray, own: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Spans (id, identity, start, length) of one bucket: in each group, the members whose document is not the smallest of it."""
    found = groups_of(ids, own, start, size, left, text, least)
    length = np.zeros(len(found.run), np.int64)
    if len(found.length):
        doc = ids[found.run]
        for group, member in found.members():
            least_ = np.minimum.reduceat(doc[member], np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
            later = doc[member] > least_[group - group[0]]
            np.maximum.at(length, member[later], found.length[group[later]])
    hit = length > 0
    r = found.run[hit]
    return ids[r], own[r], start[r] + found.nth[hit], length[hit]


def find(dealt: DataFrame, homes: int, least: int) -> DataFrame:
    """(home, kind, doc_id, body): spans to remove, by the home of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, held = None, []

        def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["home", "kind", "doc_id", "body"])

        def out() -> pa.RecordBatch:
            parts: list[tuple[np.ndarray, ...]] = []
            for body in held:
                parts.append(_read_runs(unpack(body)))
            return rows(list(_spans(*repeats_of(*(np.concatenate([p[k] for p in parts]) for k in range(6)), least), homes)))

        for batch in batches:
            for bucket, home, body in zip(*(batch.column(c) for c in ("bucket", "home", "body")), strict=True):
                if home.is_valid:
                    yield rows([(home.as_py(), body.as_py())])
                    continue
                if bucket.as_py() != at and held:
                    yield out()
                    held = []
                at = bucket.as_py()
                held.append(body.as_py())
        if held:
            yield out()

    return dealt.mapInArrow(run, "home int, kind int, doc_id long, body binary")


def _packed(docs: DataFrame, homes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, data, offsets in pieces(batch, "text", 4 << 20):
                ids = part.column("doc_id")
                home = _home(identity(data, offsets), homes)
                whole = data.tobytes()
                body = [pack(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.ones(len(ids), np.int32)), ids, pa.array(body, pa.binary())], names=["home", "kind", "doc_id", "body"])

    return docs.mapInArrow(run, "home int, kind int, doc_id long, body binary")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as disjoint, non-touching ones in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1]


def _by_row(held: list[tuple[np.ndarray, ...]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the spans of each row, by doc_id and identity."""
    if not held:
        return {}
    ids, own, start, size = (np.concatenate([h[k] for h in held]) for k in range(4))
    order = np.lexsort((own, ids))
    ids, own, start, size = ids[order], own[order], start[order], size[order]
    cut = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), len(ids)]
    return {(int(ids[lo]), int(own[lo])): (start[lo:hi], start[lo:hi] + size[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)}


def _remove(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, known, held = None, None, []
        for batch in batches:
            out = []
            for home, kind, doc_id, body in zip(*(batch.column(c) for c in ("home", "kind", "doc_id", "body")), strict=True):
                if home.as_py() != at:
                    at, known, held = home.as_py(), None, []
                if kind.as_py() == 0:
                    held.append(_read_spans(body.as_py()))
                    continue
                if known is None:
                    known, held = _by_row(held), []
                text, doc_id = unpack(body.as_py()), doc_id.as_py()
                spans = known.get((doc_id, int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)))
                if spans is None:
                    out.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                a, b = (x.tolist() for x in merged(*spans))
                kept = hashlib.sha256(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
                out.append((doc_id, len(text), sum(b) - sum(a), len(a), kept.hexdigest()))
            if out:
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def _prepared(docs: DataFrame, least: int, gram: int) -> tuple[DataFrame, DataFrame, Filter, int, int]:
    """The rows, those of them that can have repeats, the filter over these, and the numbers of buckets and homes."""
    if not 8 <= gram <= least:
        raise ValueError("gram must be 8 to least")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    numbered = docs.where(f"doc_id is not null and octet_length(text) >= {least}")
    total = numbered.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = partitions(docs.sparkSession)
    filter_ = Filter(total)
    filter_.build(numbered, least, gram)
    return docs, numbered, filter_, max(parts, total // BUCKET_BYTES), 4 * parts


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): bytes, removed bytes, removed runs and the digest of what is left.

    A null text is an empty one. Texts shorter than `least` bytes lose nothing. Rows without doc_id lose nothing and take nothing from others.
    Rows that share a doc_id are one document: they take nothing from each other, and each loses what smaller documents have. Equal ids
    are never smaller, so there are no ties. Texts of any length are cut into overlapping segments. An empty table gives no rows; further
    columns are ignored.
    """
    docs, numbered, filter_, buckets, homes = _prepared(docs, least, gram)
    parts = partitions(docs.sparkSession)
    dealt = deal_runs(numbered, filter_, buckets, homes, least, gram).repartition(parts, "bucket").sortWithinPartitions("bucket")
    rows = find(dealt, homes, least).unionByName(_packed(docs, homes))
    return _remove(rows.repartition(parts, "home").sortWithinPartitions("home", "kind"))


def repeat_groups(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(group, length, doc_id, start, passage): a row for each occurrence of each group of strings that at least two documents have.

    group is a digest of the string. Groups are the left-diverse intervals of each bucket's tree, so a string is cut where its minimizer
    changes, and a longer passage is a chain of groups that overlap by least - 1 bytes; `maximal_repeats` gives whole passages of a
    block of texts. passage (the bytes) is on the first row of each group of a bucket only. Nulls, short texts and an empty table give no rows; a
    repeated row gives its occurrences once for each.
    """
    docs, numbered, filter_, buckets, homes = _prepared(docs, least, gram)
    parts = partitions(docs.sparkSession)
    dealt = deal_runs(numbered, filter_, buckets, homes, least, gram, every=True).repartition(parts, "bucket").sortWithinPartitions("bucket")
    names = ["group", "length", "doc_id", "start", "passage"]

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, own, start, size, left, text = (np.concatenate([p[k] for p in held]) for k in range(6))
        found = groups_of(ids, own, start, size, left, text, least)
        at = np.cumsum(size) - size
        for group, member in found.members() if len(found.length) else ():
            r = found.run[member]
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = at[r] + found.nth[member]
            strings = [text[p : p + n].tobytes() for p, n in zip(place[new], found.length[group[new]], strict=True)]
            which = group - group[0]
            passage: list[bytes | None] = [None] * len(member)
            for k, x in zip(new.tolist(), strings, strict=True):
                passage[k] = x
            digest = [hashlib.md5(x).hexdigest() for x in strings]
            yield pa.RecordBatch.from_arrays([pa.array([digest[k] for k in which]), pa.array(found.length[group]), pa.array(ids[r]), pa.array(start[r] + found.nth[member]), pa.array(passage, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, held = None, []
        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body"), strict=True):
                if bucket != at and held:
                    yield from rows(held)
                    held = []
                at = bucket
                held.append(_read_runs(unpack(body.as_py())))
        if held:
            yield from rows(held)

    return dealt.mapInArrow(run, "group string, length long, doc_id long, start long, passage binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: For small tables: every string of 50 bytes with the smallest document that has it.
ORACLE_SQL = f"""
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
x as (select doc_id, n, hex(b) as h from d),
s as materialized (select doc_id, i, substr(h, 2 * i + 1, {2 * LEAST}) as w from (select doc_id, h, unnest(range(0, greatest(n - {LEAST - 1}, 0))) as i from x)),
m as (select w, min(doc_id) as least from s group by w having min(doc_id) < max(doc_id)),
r as (select distinct doc_id, i from s join m using (w) where doc_id > least),
j as (select doc_id, i, case when i > lag(i + {LEAST}) over (partition by doc_id order by i) then 1 when lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from r),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as span from j),
spans as (select doc_id, span, min(i) as a, max(i) + {LEAST} as b from g group by doc_id, span),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as prev from spans),
t as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, list(struct_pack(p := prev, a := a) order by a) as gaps from cut group by doc_id)
select x.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(gaps, lambda k: substr(h, 2 * k.p + 1, 2 * (k.a - k.p))), '') || substr(h, 2 * last + 1) end)) as kept_sha256
from x left join t on x.doc_id = t.doc_id"""
