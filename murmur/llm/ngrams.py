"""Hashed n-gram multinomials of target and raw text, for quality rules and importance resampling.

Each window of a text's bytes is hashed to one of 2**BITS buckets. The raw model counts every window
of the whole corpus, the target model those of a bounded, documented sample of trusted rows. Counting and scoring each read the
texts once; only the two count arrays of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.base import pieces

BITS = 16
#: Bound of the trusted sample.
TRUSTED_ROWS = 5_000
#: Count added to each bucket.
SMOOTH = 0.5


def buckets(data: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """The bucket of each window of n <= 8 bytes."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = data[:size].astype(np.uint64)
    for k in range(1, n):
        h |= data[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the windows of the joined bytes stay in one row."""
    ok = np.ones(max(size, 0), bool)
    for k in range(1, n):
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < size)]] = False
    return ok


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_ROWS) -> DataFrame:
    """At most `bound` doc_ids of rows with quality 1, in the order of their md5."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(bound)


def marked(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED_ROWS) -> DataFrame:
    """(doc_id, text, trusted) of all rows; the ids broadcast are at most `bound`."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.join(F.broadcast(trusted_ids(labels, bound).withColumn("trusted", F.lit(True))), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def counts(rows: DataFrame, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of target and raw windows over all rows of (text, trusted); two arrays of 2**bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                b = buckets(data, n, bits)
                ok = inside(offsets, n, len(b))
                total[0] += np.bincount(b[ok], minlength=1 << bits)
                trusted = part.column("trusted").to_numpy(zero_copy_only=False)
                if trusted.any():
                    ok &= np.repeat(trusted, np.diff(offsets))[: len(b)]
                    total[1] += np.bincount(b[ok], minlength=1 << bits)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])

    found = rows.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw_, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    raw_[found["bucket"].to_numpy(np.int64)], target[found["bucket"].to_numpy(np.int64)] = found["raw"].to_numpy(np.int64), found["target"].to_numpy(np.int64)
    return target, raw_


def log_ratio(target: np.ndarray, raw_: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log p_target - log p_raw of each bucket; 0 everywhere where there is no target text."""
    if not target.sum():
        return np.zeros(len(target), np.float32)
    p, q = target + smooth, raw_ + smooth
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log ratios of each row's windows, and their number (0 and 0 for rows of fewer than n bytes)."""
    b = buckets(data, n, bits)
    value = np.zeros(len(data) + 1)
    value[1 : len(b) + 1] = np.where(inside(offsets, n, len(b)), ratio[b], 0)
    np.cumsum(value, out=value)
    return value[offsets[1:]] - value[offsets[:-1]], np.maximum(np.diff(offsets) - n + 1, 0)

