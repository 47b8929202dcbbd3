"""MinHash near-dedup by a chosen-path set similarity join.

Each document is the set of its distinct word shingles. In each of some independent trees, a document follows the path of its minwise
tokens, one a level: a node's documents are those that share a path so far. Small nodes are compared exhaustively, larger ones branch by
the next token, so that two documents of similarity s meet with probability s**depth in a tree; trees repeat to a target recall.

Nodes compare sketches (64 minwise tokens of 8 bits) and set sizes, and name a spanning forest of the pairs that may be similar enough.
Those forests make families, which hold every pair that met and may be linked, and which are a few documents each or a large group
of near copies. Links are decided on full sets: a small family's texts meet in one task, which links exhaustively but for pairs that are
connected already. In a large family the forest's pairs are confirmed first, and then what is still apart from the family's main
component is compared with all of it, in blocks. Texts of equal words are one vertex from the start. So no pairs of a group of copies are
listed. Hashes of words only propose pairs; links are decided on sets of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import kernels as K
from murmur.llm.base import partitions, pieces, raw, table, written
from murmur.operators.components import components

LEVELS = 5
HASHES = 64
#: Least recall of a pair at the threshold in the worst case, where all its nodes branch to the last level; at least TREES trees in any case.
RECALL, TREES = 0.99, 10
#: Nodes of at most so many documents are compared exhaustively before the last level.
SMALL = 48
#: Documents are dealt to tasks by their node at level DEALT; nodes of more than LARGE documents by the last level.
DEALT, LARGE = 3, 2048
#: Documents of a large node that are tried as the centre of its star.
PIVOTS = 8
#: Deviations of the sketch's estimate below the threshold that are still compared.
SLACK = 4.4
#: A family of at most so many documents and shingles meets in one task (16 MB of hashes); larger ones are compared in blocks of about half.
FAMILY, FAMILY_SHINGLES = 4096, 2_000_000
#: Confirmations of one document in one task.
FAN = 64
#: Bits of the filter of family members for each of them, and bounds of the whole (32 MB at most); beyond them more texts are moved.
MEMBER_BITS, FILTER_MIN, FILTER_MAX = 16, 20, 28

_rng = np.random.default_rng(20_240_229)
_MUL = (_rng.integers(1 << 31, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


class Hashed(dict):
    """64-bit digests of words, with up to `most` of them kept. The digest is a cryptographic one, so that no words can be made to share it."""

    def __init__(self, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


class Numbered(dict):
    """Numbers words from 1 as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def shingles(h: list[np.ndarray], words: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes, from the hashes of its words: of `words` words, or of the whole row where it has fewer."""
    n = np.array([len(x) for x in h], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    out, at = K.grams(np.concatenate(h) if h else np.zeros(0, np.uint64), first, words)
    result = []
    for r in range(len(h)):
        if n[r] >= words:
            s = np.sort(out[at[r] : at[r + 1]])
            result.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n[r]:
            result.append(K.grams(h[r], np.array([0, n[r]]), int(n[r]))[0] if n[r] > 1 else K.mix(h[r] + np.uint64(1)))
        else:
            result.append(np.zeros(0, np.uint64))
    return result


def exact_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted sets of the shingles of some texts as numbers that are equal where the words are: words are compared themselves, not by hashes."""
    number = Numbered()
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in (t.lower().split() for t in texts)]
    some = [len(x) > 0 for x in ids]
    ids = [np.pad(x, (0, words - len(x))) if len(x) < words else x for x in ids]  # no word is 0, so a shorter text's one shingle is its own
    n = np.array([max(0, len(x) - words + 1) for x in ids])
    start = np.cumsum([0, *(len(x) for x in ids)])[:-1]
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    key, most, base = every[at], len(number), len(number) + 1
    for k in range(1, words):
        if (most + 1) * base >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            most = len(values)
        key = key * base + every[at + k]
        most = most * base + base
    edge = np.concatenate([[0], np.cumsum(n)])
    return [np.unique(key[a:b]) if x else np.zeros(0, np.int64) for a, b, x in zip(edge[:-1], edge[1:], some, strict=True)]


def minima(s: np.ndarray) -> np.ndarray:
    """The HASHES minwise tokens of a set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)[None, :]
    return (x * _MUL + _ADD).min(axis=1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a and b| >= percent |a or b|, for sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f1, f2, sig) of each row: set size, a 128-bit digest of the text's words in order, and the set's minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Hashed()
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                rows = [data[a:b].tobytes().lower().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sets = shingles([np.fromiter(map(digest.__getitem__, w), np.uint64, len(w)) for w in rows], words)
                n = np.array([len(s) for s in sets], np.int64)
                f = np.frombuffer(b"".join([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in rows]), "<i8").reshape(-1, 2)
                sig = [minima(s).astype(">u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(sig, pa.binary())], names=["doc_id", "n", "f1", "f2", "sig"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def branches(vertices: DataFrame, trees: int) -> DataFrame:
    """A row for each vertex (id, n, sig) and tree: its nodes at level DEALT and the last one, and its path and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig, _ = raw(batch.column("sig"))
            sig = sig.reshape(n, HASHES * 4)
            tokens = sig.view(">u4").astype(np.uint64)
            sketch = sig[:, 3::4]
            for t in range(trees):
                path = tokens[:, t * LEVELS : (t + 1) * LEVELS]
                keys = [np.full(n, np.uint64(t + 1))]
                for level in range(LEVELS):
                    keys.append(K.mix(keys[-1] * np.uint64(0x2545F4914F6CDD1D) + path[:, level] + np.uint64(1)))
                body = np.concatenate([sig[:, t * LEVELS * 4 : (t + 1) * LEVELS * 4], sketch], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[DEALT].view(np.int64)), pa.array(keys[LEVELS].view(np.int64)), batch.column("id"), batch.column("n"), pa.array([x.tobytes() for x in body], pa.binary())], names=["key", "leaf", "id", "n", "body"])

    return vertices.select("id", "n", "sig").mapInArrow(run, "key long, leaf long, id long, n long, body binary")


def trees_for(percent: int) -> int:
    """Trees in which a pair at the threshold, that meets in each with probability s**LEVELS or more, meets at least once with RECALL."""
    miss = 1 - (percent / 100) ** LEVELS
    return min(HASHES // LEVELS, max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log(max(miss, 1e-9))))))


def least_matches(percent: int) -> int:
    """Equal sketch bytes that two sets at the threshold have but for SLACK deviations."""
    p = percent / 100 + (1 - percent / 100) / 256
    return max(1, int(np.floor(HASHES * p - SLACK * np.sqrt(HASHES * p * (1 - p)))))


def forests(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): a spanning forest of each node's pairs that may be linked, from rows in the order of key and path."""
    least = least_matches(percent)

    def tree(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest links first, a vertex at a time; of equal links the one to the smallest id."""
        order = np.argsort(ids, kind="stable")
        ids, n, sketch = ids[order], n[order], sketch[order]
        best, by, left = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        a, b = [], []
        v = 0
        for _ in range(len(ids) - 1):
            left[v] = False
            m = (sketch == sketch[v]).sum(axis=1)
            m[(m < least) | (100 * np.minimum(n[v], n) < percent * np.maximum(n[v], n))] = 0
            better = left & (m > best)
            best[better], by[better] = m[better], v
            v = int(np.argmax(np.where(left, best, -1)))
            if best[v] > 0:
                a.append(ids[by[v]])
                b.append(ids[v])
        return np.array(a, np.int64), np.array(b, np.int64)

    def branch(level: int, *rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, n, path, sketch = rows
        if len(ids) < 2:
            return
        if len(ids) <= SMALL or level >= LEVELS:
            yield tree(ids, n, sketch)
            return
        cut = [0, *(np.flatnonzero(path[1:, level] != path[:-1, level]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                yield from branch(level + 1, *(x[lo:hi] for x in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = whole.combine_chunks()
            if not len(rows):
                return
            key, ids, n = (rows[c].to_numpy() for c in ("key", "id", "n"))
            body = raw(rows["body"])[0].reshape(len(ids), LEVELS * 4 + HASHES)
            path, sketch = np.ascontiguousarray(body[:, : LEVELS * 4]).view(">u4"), body[:, LEVELS * 4 :]
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            size = np.diff(cut)
            # nodes of two, all at once
            two = cut[:-1][size == 2]
            ok = ((sketch[two] == sketch[two + 1]).sum(axis=1) >= least) & (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1]))
            found = [(ids[two[ok]], ids[two[ok] + 1])]
            for g in np.flatnonzero(size > 2):
                s = slice(cut[g], cut[g + 1])
                found += branch(DEALT, ids[s], n[s], path[s], sketch[s])
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1])
            at = int(other[-1]) + 1 if len(other) else 0  # where the last node begins
            if at or (held and held[-1].column("key")[-1].as_py() != key[0]):
                yield from out(pa.Table.from_batches([*held, batch.slice(0, at)] if at else held))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from out(pa.Table.from_batches(held))

    return nodes.select("key", "id", "n", "body").mapInArrow(run, "a long, b long")


def star(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of last-level nodes that stay large, the links of one document each, and all rows with whether they are so linked.

    The document is the one of PIVOTS, picked by hash, with most links. A row at a time, in a join that can be split.
    """
    least = least_matches(percent)
    picked = nodes.groupBy("key", F.expr(f"pmod(xxhash64(id), {PIVOTS})").alias("_s")).agg(F.min(F.struct(F.xxhash64("id", F.lit(1)).alias("h"), "id", "n", "body")).alias("p"))
    pivots = written(picked.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("pivots")), "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            sketch = raw(batch.column("body"))[0].reshape(len(n), LEVELS * 4 + HASHES)[:, LEVELS * 4 :]
            hits = np.zeros(len(n), np.int64)
            _, first, node = np.unique(batch.column("key").to_numpy(), return_index=True, return_inverse=True)
            for g, r in enumerate(first):
                at = np.flatnonzero(node == g)
                for k, p in enumerate(batch.column("pivots")[int(r)].as_py()):
                    same = (sketch[at] == np.frombuffer(p["body"], np.uint8)[LEVELS * 4 :]).sum(axis=1)
                    ok = (same >= least) & (100 * np.minimum(n[at], p["n"]) >= percent * np.maximum(n[at], p["n"]))
                    hits[at] |= ok.astype(np.int64) << k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "n", "body")), pa.array(hits)], names=["key", "id", "n", "body", "hits"])

    marked = written(nodes.select("key", "id", "n", "body").join(pivots, "key").mapInArrow(run, "key long, id long, n long, body binary, hits long"), "marked")
    count = marked.groupBy("key").agg(F.array(*[F.count_if(F.expr(f"getbit(hits, {k}) = 1")) for k in range(PIVOTS)]).alias("c"))
    best = count.select("key", F.expr("array_position(c, array_max(c))").cast("int").alias("k")).join(pivots, "key").select("key", "k", F.expr("element_at(pivots, k).id").alias("pivot"))
    rows = marked.join(best, "key").withColumn("joined", F.expr("getbit(hits, k - 1) = 1")).drop("hits", "k")
    return rows.where("joined and id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")), rows.drop("pivot")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of star() whose node has any that are not joined, dealt to pairs of blocks of about LARGE / 2: each such row meets all rows of its node."""
    number = rows.groupBy("key").agg(F.count_if(~F.col("joined")).alias("_a"), F.count(F.lit(1)).alias("_n")).where("_a > 0")
    number = number.selectExpr("key", f"cast(ceil(_a / {LARGE // 2}) as int) as _l", f"cast(ceil(_n / {LARGE // 2}) as int) as _r")
    every = rows.join(number, "key")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    other = lambda n: F.expr(f"explode(sequence(0, {n} - 1))")
    left = every.where("not joined").select("key", own("_l").alias("i"), other("_r").alias("j"), "id", "n", "body")
    right = every.select("key", other("_l").alias("i"), own("_r").alias("j"), "id", "n", "body")
    return left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("key"), "id", "n", "body")


def propose(vertices: DataFrame, trees: int, percent: int) -> DataFrame:
    """The forests of all trees. No node of many documents reaches one task: large ones are dealt by their last level, and what is large there
    is a star, besides which each document that is not in it is compared with all of the node, in pairs of blocks."""
    parts = partitions(vertices.sparkSession)
    rows = branches(vertices, trees)
    large = lambda df: written(df.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select("key"), "large")
    dealt = lambda df: forests(df.repartition(parts, "key").sortWithinPartitions("key", "body"), percent)
    hot = large(rows.select("key"))
    if hot.isEmpty():
        return dealt(rows).distinct()
    deep = written(rows.join(hot, "key", "left_semi").withColumn("key", F.col("leaf")), "deep")
    out = dealt(rows.join(hot, "key", "left_anti"))
    hot = large(deep.select("key"))
    out = out.unionByName(dealt(deep.join(hot, "key", "left_anti")))
    if hot.isEmpty():
        return out.distinct()
    links, rows = star(deep.join(hot, "key", "left_semi"), percent)
    return out.unionByName(links).unionByName(dealt(blocks(rows))).distinct()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, z): compressed texts of the given ids, and of few others: a filter by a hash of the id leaves most of the rest where they are."""
    size = 1 << min(FILTER_MAX, max(FILTER_MIN, (MEMBER_BITS * ids.count()).bit_length()))
    place = F.expr(f"pmod(xxhash64(id), {size}L)")
    marks = ids.select((place + 1).alias("h"))  # bitmap positions count from 1
    marks = marks.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for r in marks:
        bits[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    packed = zstandard.compress(bits.tobytes(), 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(zstandard.decompress(packed), np.uint8)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            h = batch.column("h").to_numpy()
            part = batch.filter(pa.array((flags[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([zip_(t.as_buffer()) for t in part.column("text")], pa.binary())], names=["id", "z"])

    rows = docs.selectExpr("cast(doc_id as long) id", "cast(text as string) text").where("id is not null and text is not null")
    return rows.withColumn("h", place).mapInArrow(run, "id long, z binary")


class Index:
    """Postings of some sets, for intersection sizes."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        every = np.concatenate([sets[m] for m in members])
        owner = np.repeat(members, [len(sets[m]) for m in members])
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.values, self.first = every[first], np.append(first, len(every))

    def common(self, s: np.ndarray, total: int) -> np.ndarray:
        """The size of the intersection of s with each set, by member."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        size = self.first[at + 1] - self.first[at]
        start = self.first[at]
        places = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.owner[places], minlength=total)


def linked(common: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size + sizes - common)


def clusters(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a family. Documents already reached are not compared again."""
    if len(ids) == 2:
        return [(int(ids[0]), int(ids[1]))] if similar(sets[0], sets[1], percent) else []
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(ids), bool)
    index = Index(sets, np.arange(len(ids)))
    out = []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            x = queue.pop()
            if 2 * left.sum() < len(index.members):
                index = Index(sets, np.flatnonzero(left))
            hit = np.flatnonzero(left & linked(index.common(sets[x], len(ids)), sizes[x], sizes, percent) & (sizes > 0))
            left[hit] = False
            queue += hit.tolist()
            out += [(int(ids[x]), int(ids[y])) for y in hit]
    return out


def _by_key(columns: tuple[str, ...]):
    """Rows of (key columns..., id, ..., z) as lists, a key at a time."""

    def groups_(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                key = row[: len(columns)]
                if key != at and held:
                    yield at, held
                    held = []
                at = key
                held.append(row[len(columns) :])
        if held:
            yield at, held

    return groups_


def _sets(zs: list[bytes], words: int) -> list[np.ndarray]:
    return exact_sets([zstandard.decompress(z) for z in zs], words)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


def link_small(families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the smallest document b that each other document a of a family (family, id) reaches; a family meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(("family",))(batches):
            # rows are in the order of id, so links go from the smaller document on
            least: dict[int, int] = {}
            for a, b in clusters(np.array([r[0] for r in rows]), _sets([r[1] for r in rows], words), percent):
                least[b] = least.get(a, a)
            if least:
                yield _pairs([(a, b) for a, b in least.items() if a != b])

    rows = families.join(texts, "id").select("family", "id", "z")
    return rows.repartition(partitions(families.sparkSession), "family").sortWithinPartitions("family", "id").mapInArrow(run, "a long, b long")


def link_blocks(apart: DataFrame, families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of documents that are apart (family, id, comp) with any of their family (family, id, comp), in pairs of blocks; one for each other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(("family", "i", "j"))(batches):
            sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
            if not all(sides):
                continue
            sets = _sets([r[3] for side in sides for r in side], words)
            mine, sets = sets[: len(sides[0])], sets[len(sides[0]) :]
            sizes, comp = np.array([len(s) for s in sets]), np.array([r[2] for r in sides[1]])
            index, found = Index(sets, np.arange(len(sets))), []
            for (_, id_, own, _), s in zip(sides[0], mine, strict=True):
                hit = np.flatnonzero(linked(index.common(s, len(sets)), len(s), sizes, percent) & (comp != own) & (sizes > 0))
                _, first = np.unique(comp[hit], return_index=True)
                found += [(id_, sides[1][k][1]) for k in hit[first]]
            if found:
                yield _pairs(found)

    blocks = lambda df, name: df.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (FAMILY // 2)), F.ceil(F.sum("n") / (FAMILY_SHINGLES // 2))).cast("int").alias(name))
    number = blocks(apart, "_l").join(blocks(families, "_r"), "family")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    other = lambda n: F.expr(f"explode(sequence(0, {n} - 1))")
    left = apart.join(number, "family").select("family", own("_l").alias("i"), other("_r").alias("j"), F.lit(0).alias("side"), "id", "comp")
    right = families.join(number, "family").select("family", other("_l").alias("i"), own("_r").alias("j"), F.lit(1).alias("side"), "id", "comp")
    rows = left.unionByName(right).join(texts, "id").select("family", "i", "j", "side", "id", "comp", "z")
    return rows.repartition(partitions(families.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "id").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Partners of one document are spread over tasks, FAN to each."""
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    dealt = pairs.join(fan, "a").selectExpr("a", f"pmod(xxhash64(b), _n div {FAN} + 1) as salt", "b")
    ends = dealt.selectExpr("a", "salt", "b as id").unionByName(dealt.selectExpr("a", "salt", "a as id").distinct())
    ends = ends.join(texts, "id").selectExpr("a", "salt", "id <> a as other", "id", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, _), rows in _by_key(("a", "salt"))(batches):
            sets = _sets([z for _, _, z in rows], words)
            own = [x for (other, _, _), x in zip(rows, sets, strict=True) if not other]
            found = [(a, id_) for (other, id_, _), x in zip(rows, sets, strict=True) if other and any(similar(x, o, percent) for o in own)]
            if found:
                yield _pairs(found)

    return ends.repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents are linked where 100 |A and B| >= percent |A or B| on their distinct shingles of `words` words; component_id is the smallest doc_id
    reachable. Null and empty texts, and those without words, are linked with nothing. Rows that share a doc_id are one vertex. A row
    without doc_id is linked with nothing, has no component_id, and is kept. Further columns are ignored; an empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    sets = written(signatures(docs, words), "signatures")
    full = sets.where("n > 0 and doc_id is not null")
    vertices = written(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "vertices")
    # a doc_id with several sets links their vertices
    several = full.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("doc_id")
    copies = written(full.join(several, "doc_id", "left_semi").join(vertices.drop("sig"), ["f1", "f2", "n"]).selectExpr("doc_id as a", "id as b").where("a <> b"), "copies")
    any_copies = not copies.isEmpty()

    pairs = written(propose(vertices, trees_for(percent), percent), "pairs")
    family = components(pairs)
    family = family.selectExpr("node as id", "component as family").unionByName(family.selectExpr("component as id", "component as family").distinct())
    family = written(family.join(vertices.groupBy("id").agg(F.max("n").alias("n")), "id"), "families")
    size = family.groupBy("family").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    large = written(size.where(f"_c > {FAMILY} or _s > {FAMILY_SHINGLES}").select("family"), "large-families")
    texts = texts_of(family.select("id"), docs)
    if large.isEmpty():
        links = link_small(family.select("family", "id"), texts, words, percent)
    else:
        big = family.join(large, "family", "left_semi")
        links = link_small(family.join(large, "family", "left_anti").select("family", "id"), texts, words, percent)
        near = components(written(confirm(pairs.join(big.selectExpr("id as a"), "a", "left_semi"), texts, words, percent), "links"))
        big = written(big.join(near.selectExpr("node as id", "component as comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "large-members")
        parts = big.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("_n"))
        main = parts.groupBy("family").agg(F.max_by("comp", F.struct("_n", "comp")).alias("main"))
        apart = big.join(main, "family").where("comp <> main").drop("main")
        more = written(link_blocks(apart, big.join(apart.select("family").distinct(), "family", "left_semi"), texts, words, percent), "links")
        near = near.selectExpr("node as a", "component as b")
        if not more.isEmpty():
            near = components(near.unionByName(more)).selectExpr("node as a", "component as b")
        links = links.unionByName(near)
    if any_copies:
        links = components(links.unionByName(copies)).selectExpr("node as a", "component as b")
    out = sets.where("n > 0").select("doc_id", "n", "f1", "f2").join(vertices.select("f1", "f2", "n", "id"), ["f1", "f2", "n"], "left").select("doc_id", "n", "id")
    out = out.join(links.selectExpr("a as id", "b as component"), "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("_c"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("_c")).alias("component_id"))
    # rows without words stay out of the joins, where they would all share one key
    out = out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


#: For small tables: all pairs that share a shingle, and reachability.
ORACLE_SQL = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
    select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as set_ from w
), e as materialized (
    select doc_id, len(set_) as n, unnest(set_) as h from s
), p as materialized (
    select a.doc_id as x, b.doc_id as y from e a join e b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), sym as materialized (select x, y from p union all select y, x from p),
reach(doc_id, c) as (
    select doc_id, doc_id from s union select sym.y, reach.c from reach join sym on reach.doc_id = sym.x where reach.c < sym.y
)
select s.doc_id, len(set_) as n_shingles, min(c) as component_id, s.doc_id = min(c) as kept from s join reach on s.doc_id = reach.doc_id group by s.doc_id, set_"""
