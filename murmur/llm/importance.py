"""Importance resampling: rows drawn in proportion to target/raw likelihood ratios, by Gumbel top-k.

A text's log weight is the sum over its hashed byte windows of log p_target/p_raw. Its key is that weight plus Gumbel noise that depends on
doc_id alone; the k rows with the largest keys are a sample without replacement in proportion to the weights. The k-th key is found by
counting keys in ranges of their bits, so no sort or row ever gathers in one task, and ties are broken by doc_id.

The log weight of a whole text is a sum over thousands of windows. It spreads over hundreds of nats and more, against a standard deviation of 1.3 of
the noise, so among long texts the draw is close to the k largest weights; noise decides between texts of nearly equal weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import kernels as K
from murmur.llm import ngrams
from murmur.llm.base import fresh, pieces, table, written

WINDOW = 5
BITS = 18
SEED = 7
#: Share of rows drawn where the labels give none.
SHARE = 0.8

SCHEMA = "doc_id long, n_grams long, log_weight double, gumbel double, sample_key double"


def gumbel(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise from a hash of each id."""
    h = K.mix(K.mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ np.uint64(0xA0761D6478BD642F))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


def keys(docs: DataFrame, ratio: np.ndarray, window: int = WINDOW, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, log weight, noise and key of each row. Null and empty texts have a weight of 0; a null doc_id has the noise of -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                total, n = ngrams.scores(data, offsets, ratio, window, bits)
                noise = gumbel(part.column("doc_id").fill_null(-1).to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n, total, noise, total + noise))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def top_k(rows: DataFrame, k: int, key: str = "sample_key", tie: str = "doc_id") -> DataFrame:
    """rows with `kept`, true for exactly k rows (all, if there are fewer): those with the largest keys (to 2**-20), equal keys by smaller ids.

    Rows that tie in both are taken in the order in which they are stored; null keys and ids come last. Each pass counts rows by the next 16
    bits of the key, then of the id, then of the place, within the range that holds the k-th row, and sends at most 2**16 counts to the
    driver. rows are written once, so that every pass and every retried task sees the same places. A column `kept` of rows is replaced, all
    others stay as they are; an empty table gives no rows.
    """
    high = 1 << 62
    rows = rows.drop("kept")
    first, second, third = names = fresh([*rows.columns, "kept"], "key", "tie", "place")
    place = F.lit(high) - F.coalesce(F.round(F.col(key) * F.lit(2.0**20)).cast("long"), F.lit(-(high - 1)))
    ranked = rows.withColumns({first: place, second: F.coalesce(F.col(tie).cast("long"), F.lit(high - 1)) + F.lit(high), third: F.monotonically_increasing_id()})
    ranked = written(ranked, "ranked")
    left, chosen, within = k, F.lit(False), F.lit(True)
    for column in names:
        for shift in (48, 32, 16, 0):
            part = F.shiftrightunsigned(column, shift)
            cut = None
            for p, n in sorted(tuple(r) for r in ranked.where(within).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
                if n > left:
                    cut = p
                    break
                left -= n
            if cut is None:
                return ranked.withColumn("kept", chosen | within).drop(*names)
            chosen, within = chosen | (within & (part < cut)), within & (part == cut)
            if not left:
                return ranked.withColumn("kept", chosen).drop(*names)
    return ranked.withColumn("kept", chosen).drop(*names)


def draw_count(labels: DataFrame, rows: int) -> int:
    """The share of labelled rows that are of target quality, of all rows."""
    r = labels.where("quality is not null").agg(F.avg("quality").alias("share")).first()
    return round(rows * (SHARE if r.share is None else r.share))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its weight, noise and key, and whether it is drawn."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    target, raw = ngrams.counts(ngrams.marked(docs, labels), WINDOW, BITS)
    rows = keys(docs, ngrams.log_ratio(target, raw))
    return top_k(rows, draw_count(labels, docs.count()))
