"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (with marks at its ends), and a passage's, of WORDS
words in a row, the mean of its words' vectors, which a linear softmax layer reads. A text's score is that of its most toxic passage, in training as
in use: after an epoch on averages of whole texts, each round takes the passages that the model finds most toxic, one of a toxic
text and CLEAN_PASSAGES of a clean one, as the texts' examples, and fits embeddings and layer together. So a few words in a long text are not
averaged away. A calibration on texts left out of training sets slope and cut. Misspellings that training never saw share n-grams, and so
vectors, with words that it did see. As the layer is linear, a trained model scores a passage as a mean of one number per n-gram: one table
of 2**BITS floats, which does not grow with the data. Only texts are inputs: labels, language, source and doc_id are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm import kernels as K
from murmur.llm.base import pieces, table

BITS = 17
GRAMS = (3, 4, 5)
DIM = 8
#: Bounds of the labelled sample the model is fitted on: rows of each class, in the order of their md5.
TOXIC_ROWS = 1_500
CLEAN_ROWS = 2_500
#: Bytes of the sample's texts, which reach the driver: of each class half, whole texts in the same order for as long as they fit.
SAMPLE_BYTES = 64 << 20
#: Words of a passage, and passages of a clean text that a round learns from.
WORDS = 2
CLEAN_PASSAGES = 3
#: Epochs over averages of whole texts, and rounds over passages.
EPOCHS, ROUNDS = 1, 3
RATE = 0.1
#: n-grams that fewer texts of the sample have keep a value of 0, as they could only be learnt by heart.
LEAST_TEXTS = 3
#: The averaged vector is multiplied by this before the softmax layer, as a few words in hundreds decide.
GAIN = 50.0
CUT = 0.7

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _letters() -> np.ndarray:
    """Bytes that words are made of: ASCII letters (lower-cased) and digits, and all bytes of other characters; the rest become spaces."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if chr(b).isalnum() and b < 128 or b >= 128:
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


LETTERS = _letters()


def gram_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: buckets of all n-byte windows of the marked text, and for each word the range of its windows. Last: words by row, and the
    places of each word in the marked text, which has a byte more before each row."""
    # a space before each row and at the end, so that words have marks on both sides
    rows = len(offsets) - 1
    at = offsets[:-1] + np.arange(rows)
    text = np.full(len(data) + rows + 1, 32, np.uint8)
    body = np.ones(len(text), bool)
    body[at] = False
    body[-1] = False
    text[body] = LETTERS[data]
    starts, ends, first = K.runs(text != 32, np.concatenate([at, [len(text)]]))
    for n in GRAMS:
        size = max(len(text) - n + 1, 0)
        h = text[:size].astype(np.uint64)
        for k in range(1, n):
            h |= text[k : k + size].astype(np.uint64) << np.uint64(8 * k)
        b = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        lo = np.minimum(starts - 1, size)
        hi = np.maximum(np.minimum(ends + 2 - n, size), lo)  # windows [lo, hi) lie in the marked word
        yield b, lo, hi, first, starts, ends


def passages(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each passage (and their number), and the first passage of each row. Rows without words have none."""
    n = np.diff(first)
    count = -(-n // words)
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    return np.append(first[:-1][row] + words * (np.arange(at[-1]) - at[:-1][row]), first[-1]), at


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's buckets and weights: its vector is the weighted sum of its buckets' embeddings, a mean of means."""
    found = list(gram_rows(data, offsets))
    first = found[0][3]
    grams = sum(f[2] - f[1] for f in found)
    out = []
    for r in range(len(offsets) - 1):
        words = slice(first[r], first[r + 1])
        weight = 1.0 / (np.maximum(grams[words], 1) * max(1, first[r + 1] - first[r]))
        ids, w = [], []
        for b, lo, hi, *_ in found:
            size = (hi - lo)[words]
            ids.append(b[np.repeat(lo[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            w.append(np.repeat(weight, size))
        bucket, back = np.unique(np.concatenate(ids), return_inverse=True)
        out.append((bucket, np.bincount(back, np.concatenate(w), minlength=len(bucket)).astype(np.float32)))
    return out


def logits(data: np.ndarray, offsets: np.ndarray, value: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage the mean over its words of the means of `value` over their n-grams, and its place in data [from, to); the first passage of each row."""
    total, grams, first, starts, ends = 0.0, 0, None, None, None
    for b, lo, hi, first, starts, ends in gram_rows(data, offsets):
        sums = np.zeros(len(b) + 1)
        np.cumsum(value[b], out=sums[1:])
        total = total + sums[hi] - sums[lo]
        grams = grams + hi - lo
    begin, at = passages(first, words)
    mean = K.sums(total / np.maximum(grams, 1), begin) / np.maximum(np.diff(begin), 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1
    place = np.stack([starts[begin[:-1]] - row, ends[np.minimum(begin[1:], first[row]) - 1] - row], axis=1) if len(mean) else np.zeros((0, 2), np.int64)
    return mean, place, at


def peaks(data: np.ndarray, offsets: np.ndarray, value: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The largest passage of each row; 0 for rows without words."""
    mean, _, at = logits(data, offsets, value, words)
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.maximum.reduceat(mean, at[:-1][some])
    return out


@dataclass
class Model:
    """value: each bucket's part of the logit difference; slope and shift: calibration."""

    value: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    words: int = WORDS

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The softmax's share of the toxic class, of each row's most toxic passage."""
        z = self.slope * peaks(data, offsets, self.value, self.words) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def train(rows: list[tuple[int, bytes]], epochs: int = EPOCHS, rounds: int = ROUNDS, words: int = WORDS, rate: float = RATE, dim: int = DIM, seed: int = 1, clean_weight: float = 1.0) -> Model:
    """Embeddings and the softmax layer by Adagrad, an example at a time; every fifth text of a class is left out, for calibration.

    rows: (label, text). clean_weight: how many clean rows of the corpus one clean row of the sample stands for, against toxic ones. Without
    rows of both classes every text scores below one half.
    """
    labels = np.array([y for y, _ in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, -1.0, words)
    rng = np.random.default_rng(seed)
    of_class = {c: [k for k in range(len(rows)) if labels[k] == c] for c in (0, 1)}
    held = sorted(k for c in of_class for k in of_class[c][::5]) if min(map(len, of_class.values())) >= 10 else list(range(len(rows)))
    fit = [k for k in range(len(rows)) if k not in set(held)] or held
    blocks = [fit[lo : lo + 200] for lo in range(0, len(fit), 200)]
    bags = [(labels[k], *bag) for part in blocks for k, bag in zip(part, features(*joined([rows[k][1] for k in part])), strict=True) if len(bag[0])]
    texts = np.zeros(1 << BITS, np.int32)
    for _, ids, _ in bags:
        texts[ids] += 1
    known = (texts >= min(LEAST_TEXTS, max(1, len(bags) // 20))).astype(np.float32)
    embed = rng.normal(0, 0.01, (1 << BITS, dim)).astype(np.float32) * known[:, None]
    layer = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_embed, g_layer, g_bias = np.full(1 << BITS, 1e-4, np.float32), np.full((dim, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def learn(examples: list[tuple[int, np.ndarray, np.ndarray]], begin: float, end: float) -> None:
        """One pass over (label, buckets, weights); the rate falls from begin to end. Both classes weigh the same."""
        count = np.bincount([y for y, _, _ in examples], minlength=2)
        own = 0.5 * len(examples) / np.maximum(count, 1)
        for done, k in enumerate(rng.permutation(len(examples))):
            step = begin + (end - begin) * done / len(examples)
            y, ids, w = examples[k]
            w, e = GAIN * w, embed[ids]
            v = w @ e
            z = v @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= own[y]
            back, slope = layer @ p, np.outer(v, p)
            g_layer[:] += slope * slope
            g_bias[:] += p * p
            g_embed[ids] += w * w * float(back @ back) / dim
            embed[ids] = e - (step * w * known[ids] / np.sqrt(g_embed[ids]))[:, None] * back
            layer[:] -= step * slope / np.sqrt(g_layer)
            bias[:] -= step * p / np.sqrt(g_bias)

    def values() -> np.ndarray:
        return (GAIN * embed @ (layer[:, 1] - layer[:, 0])).astype(np.float32)

    for epoch in range(epochs):
        learn(bags, rate, rate)
    for r in range(rounds):
        value, examples = values(), []
        for part in blocks:
            data, offsets = joined([rows[k][1] for k in part])
            mean, place, at = logits(data, offsets, value, words)
            picked = [(labels[k], p) for j, k in enumerate(part) for p in at[j] + np.argsort(-mean[at[j] : at[j + 1]], kind="stable")[: 1 if labels[k] else CLEAN_PASSAGES]]
            cut = [data[place[p, 0] : place[p, 1]].tobytes() for _, p in picked]
            examples += [(y, *bag) for (y, _), bag in zip(picked, features(*joined(cut)), strict=True) if len(bag[0])] if cut else []
        if examples:
            learn(examples, rate * (1 - r / rounds), rate * (1 - (r + 1) / rounds))
    value = values()
    z = np.concatenate([peaks(*joined([rows[k][1] for k in held[lo : lo + 200]]), value, words) for lo in range(0, len(held), 200)])
    return Model(value, *calibrate(z, labels[held], clean_weight), words)


def calibrate(z: np.ndarray, y: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and shift with which CUT separates best (F1 with clean rows weighted); in the best gap nearer to the clean rows, as misspellings score lower."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    pos, neg = np.cumsum(y[::-1])[::-1], np.cumsum((1 - y)[::-1])[::-1] * clean_weight
    f1 = 2 * pos / (pos + neg + y.sum())
    k = int(np.argmax(f1))
    at = z[k - 1] + 0.3 * (z[k] - z[k - 1]) if k else z[0] - 1e-6
    spread = max(1e-9, float(z[y == 1].mean() - z[y == 0].mean()) / 2)
    slope = 2.0 / spread
    return slope, float(np.log(CUT / (1 - CUT)) - slope * at)


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> list[tuple[int, bytes]]:
    """(label, text) of the labelled rows to learn from: never those whose crc32(doc_id) mod 3 is 1, and at most the given numbers of a class."""
    # a row that is labelled both ways counts as toxic
    own = labels.where("doc_id is not null and toxic is not null").where(fold_of() != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    ids = own.where("toxic = 1").orderBy(order).limit(toxic_rows).union(own.where("toxic = 0").orderBy(order).limit(clean_rows))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(ids), "doc_id")
    # rows that share a doc_id count once, the smallest text of them
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    # of the rows of a class, which are at most toxic_rows or clean_rows
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    rows = rows.withColumn("size", size.cast("long")).where(F.col("size") <= SAMPLE_BYTES // 2)
    return [(r.toxic, (r.text or "").encode()) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def clean_share(labels: DataFrame) -> tuple[int, int]:
    r = labels.where("toxic is not null").where(fold_of() != 1).agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    return r.toxic, r.clean


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)
    toxic, clean = clean_share(labels)
    y = [label for label, _ in rows]
    weight = (clean / max(1, y.count(0))) / max(1e-9, toxic / max(1, y.count(1))) if toxic and clean else 1.0
    return train(rows, clean_weight=weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    Texts that are null, empty or without words get the score of the calibration's shift. Null ids are not held out; repeated rows each
    get their row; whole texts are scored, however long; an empty table gives no rows and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(data, offsets))], names=["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold_of() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns of any name, that are not predicted toxic: null and empty texts, null ids and repeated rows are judged like
    all others, by their text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                yield part.filter(pa.array(model.score(data, offsets) < CUT))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
