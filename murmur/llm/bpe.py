"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, with a literal rank map; decoding concatenates binary pieces.

Two forms of the same fold are here and give equal ids. `encode_words` is the fold in Spark's higher-order functions over a column of
distinct words, with the rank map as a literal (an array of small maps, picked by the piece's hash). The corpus query uses `Vocabulary.encode`,
the same fold as array operations over all distinct words of a batch at once, as the first form takes more CPU time than the check
allows (README has figures). Distinct words are kept per task up to a fixed number, so no word table is shuffled or broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from murmur.llm.base import raw, table

#: Distinct words a task remembers before it starts anew.
WORDS = 300_000
#: Words of more bytes than this are merged by a heap, one at a time.
LONG = 64
CHUNK = 1 << 20
NO_RANK = 1 << 30
#: Parts of the literal rank map of encode_words.
BUCKETS = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line of base64 and a rank for each piece."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


class Words(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """Ranks as arrays: a hash table from pairs of ids to the id of their concatenation, and each id's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.full(256, -1, np.int32)
        for k, v in ranks.items():
            if len(k) == 1:
                self.byte[k[0]] = v
        if (self.byte < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        pairs = [(ranks[k[:i]] << 20 | ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        keys, ids = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        slot = self._slot(keys)
        while len(keys):  # linear probing, all keys a step at a time
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ids[slot[put]] = keys[put], ids[put]
            keys, ids, slot = keys[~put], ids[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for k, v in ranks.items():
            pieces[v] = k
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's concatenation, NO_RANK where the vocabulary has none."""
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        out = self.ids[slot]
        seen = self.keys[slot]
        miss = np.flatnonzero((seen != keys) & (seen >= 0))
        out[seen != keys] = NO_RANK
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[miss]]
            hit = seen == keys[miss]
            out[miss[hit]] = self.ids[slot[miss[hit]]]
            miss = miss[~hit & (seen >= 0)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin (and their number): a fold that merges each word's lowest-ranked pair a round."""
        n = np.array([len(w) for w in words], np.int64)
        result: list[np.ndarray | None] = [None] * len(words)
        whole = [self.ranks.get(w) for w in words]  # a word that is a piece is one id
        todo = []
        for k, v in enumerate(whole):
            if v is not None:
                result[k] = np.array([v], np.int32)
            elif n[k] > LONG:
                result[k] = self._one(words[k])
            elif n[k]:
                todo.append(k)
            else:
                result[k] = np.zeros(0, np.int32)
        word = np.array(todo, np.int64)
        if len(word):
            size = n[word]
            ids = self.byte[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
            rank = self._pairs(ids, size)
        while len(word):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(rank)), first)
            over = (best >> 32) >= NO_RANK
            if over.any():
                for k in np.flatnonzero(over):
                    result[word[k]] = ids[first[k] : first[k] + size[k]].copy()
                stay = np.repeat(~over, size)
                moved = np.cumsum(stay) - 1
                best = (best[~over] >> 32 << 32) | moved[(best[~over]) & 0xFFFFFFFF]
                ids, rank, word, size = ids[stay], rank[stay], word[~over], size[~over]
                if not len(word):
                    break
                first = np.cumsum(size) - size
            at = best & 0xFFFFFFFF
            ids[at] = best >> 32
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            ids, rank = ids[gone], rank[gone]
            at = at - np.arange(len(at))  # one id of each word before it is gone
            size = size - 1
            first = np.cumsum(size) - size
            last = first + size - 1
            rank[last] = NO_RANK
            inner = at < last
            rank[at[inner]] = self.merged(ids[at[inner]], ids[at[inner] + 1])
            before = at > first
            rank[at[before] - 1] = self.merged(ids[at[before] - 1], ids[at[before]])
        counts = np.array([len(x) for x in result], np.int64)
        return (np.concatenate(result) if result else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    def _pairs(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), NO_RANK, np.int32)
        rank[:-1] = self.merged(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = NO_RANK
        return rank

    def _one(self, word: bytes) -> np.ndarray:
        """The same merges by a heap, for long words."""
        part = [word[k : k + 1] for k in range(len(word))]
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        alive = [True] * len(part)
        rank = lambda a, b: self.ranks.get(part[a] + part[b], NO_RANK)
        heap = [(r, k, 1, 1) for k in range(len(part) - 1) if (r := rank(k, k + 1)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, k, la, lb = heapq.heappop(heap)
            m = after[k]
            if not alive[k] or m < 0 or len(part[k]) != la or len(part[m]) != lb:
                continue
            part[k] += part[m]
            alive[m], after[k] = False, after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank(a, b)) < NO_RANK:
                    heapq.heappush(heap, (r, a, len(part[a]), len(part[b])))
        return np.array([self.ranks[p] for p, x in zip(part, alive, strict=True) if x], np.int32)


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of the slices values[start : start + size]."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return values[np.repeat(start - first, size) + np.arange(total)]


def encoder(ranks: dict[bytes, int], pattern: str, words: int = WORDS):
    """A mapInArrow function over (doc_id, text) that yields, for each row, (doc_id, ids, decoded bytes) through `emit`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        vocabulary, find = Vocabulary(ranks), regex.compile(pattern).findall
        known, ids, start = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            texts, at = batch.column("text"), 0
            _, offsets = raw(texts)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
                if len(known) > words:
                    known, ids, start = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)
                had = len(known)
                found = []
                for k in range(at, to):
                    hits = find(texts[k].as_py() or "")
                    found.append(np.fromiter(map(known.__getitem__, hits), np.int32, len(hits)))
                new = [w.encode() for w in list(known)[had:]] if len(known) > had else []
                more, first = vocabulary.encode(new)
                start = np.concatenate([start, start[-1] + first[1:]])
                ids = np.concatenate([ids, more])
                size = np.diff(start)
                for k, w in zip(range(at, to), found, strict=True):
                    out = spread(ids, start[w], size[w])
                    yield batch.column("doc_id")[k].as_py(), out, spread(vocabulary.bytes, vocabulary.start[out], vocabulary.length[out])
                at = to

    return rows


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, the columns of `keep`, the number of ids, and digests of the ids and of the decoded bytes.

    Null and empty texts have no ids. Repeated rows and rows without doc_id each get a row, an empty table gives none, and columns that are not
    kept are ignored, whatever their names. Whole texts are encoded: a word (a match of the pattern) of any length is merged by a heap, in memory
    of some 200 times its bytes, so an unbroken run of letters of over 5 MB needs over 1 GB; other texts need a few times their size.
    """
    rows = encoder(ranks, pattern)
    kinds = [docs.schema[c].dataType for c in keep]
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at[:] = [batch]
                yield batch

        out: list[tuple] = []
        for _, ids, back in rows(watched()):
            out.append((len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), hashlib.sha256(back).hexdigest()))
            if len(out) == at[0].num_rows:
                found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([at[0].column(0), *(at[0].column(2 + k) for k in range(len(keep))), *found], names=["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"])
                out = []

    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, t) for c, t in zip(keep, kinds, strict=True)], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return taken.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text), as `digests` says of odd rows."""
    rows = encoder(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, _ in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Binary of an array of ids by Spark functions: pieces are picked from a literal array and concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(literal, i + 1)), ""))


def encode_words(df: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """df with `pieces`: the word's pieces (hex) by ranked merges, folded by higher-order functions. For distinct words."""
    pairs = df.sparkSession.createDataFrame([(k.hex(), v) for k, v in ranks.items() if len(k) > 1], "k string, v int")
    parts: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for r in pairs.select("k", "v", F.expr(f"pmod(hash(k), {BUCKETS})").alias("b")).collect():  # the vocabulary, of fixed size
        parts[r.b][r.k] = r.v
    rank = lambda e: f"coalesce(element_at(element_at(_ranks, pmod(hash({e}), {BUCKETS}) + 1), {e}), {NO_RANK})"
    empty = "cast(array() as array<int>)"
    merged = "concat(slice(s.p, 1, i - 1), array(concat(element_at(s.p, i), element_at(s.p, i + 1))), slice(s.p, i + 2, size(s.p)))"
    left, right = (rank(f"concat(q[i - {a}], q[i - {a - 1}])") for a in (2, 1))
    step = f"""transform(array(cast(array_position(s.r, array_min(s.r)) as int)), i -> transform(array({merged}), q ->
        named_struct('p', q, 'r', if(size(q) < 2, array({NO_RANK}), concat(slice(s.r, 1, greatest(i - 2, 0)),
            if(i > 1, array({left}), {empty}), if(i < size(q), array({right}), {empty}), slice(s.r, i + 2, size(s.r))))))[0])[0]"""
    begin = f"""transform(array(regexp_extract_all(_hex, '..', 0)), p -> named_struct('p', p, 'r',
        if(size(p) < 2, array({NO_RANK}), transform(slice(p, 1, size(p) - 1), (x, k) -> {rank("concat(x, p[k + 1])")}))))[0]"""
    fold = f"aggregate(sequence(1, greatest(length(_hex) div 2 - 1, 1)), {begin}, (s, _) -> if(array_min(s.r) = {NO_RANK}, s, {step}), s -> s.p)"
    literal = F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<map<string,int>>")
    rows = df.withColumn("_hex", F.hex(F.encode(F.col(column), "UTF-8"))).withColumn("_hex", F.lower("_hex")).withColumn("_ranks", literal)
    return rows.withColumn("pieces", F.expr(f"if(_hex = '', cast(array() as array<string>), {fold})")).drop("_hex", "_ranks")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())
