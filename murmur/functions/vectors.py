"""Vector, set and distribution functions over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from murmur.functions.normalize import col


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where either norm is 0; arrays of different lengths raise."""
    a, b = col(a), col(b)
    value = F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def unit_cosine(a: str | Column, b: str | Column) -> Column:
    """(cosine + 1) / 2 within 0 and 1; null where the cosine is."""
    value = (cosine(a, b) + 1) / 2
    return F.when(value < 0, 0.0).when(value > 1, 1.0).otherwise(value)  # greatest and least would skip nulls


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Null where both sets are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def bit_sets(rows: DataFrame, key: str, value: Column, size: int) -> DataFrame:
    """(key, bits): each key's set of values 0 to size - 1 as an array of longs, 64 values in each. Nulls are no members; other values raise."""
    out = F.raise_error(F.concat(F.lit("not within the set: "), value.cast("string"))).cast("long")
    at = F.when((value >= 0) & (value < size), value.cast("long")).when(value.isNotNull(), out)
    word = lambda k: F.bit_or(F.when(F.floor(at / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(key).agg(F.array(*[word(k) for k in range(-(-size // 64))]).alias("bits"))


def jaccard_of_bits(a: str | Column, b: str | Column, words: int = 1) -> Column:
    """The same of sets from bit_sets."""
    a, b = col(a), col(b)
    both = sum((F.bit_count(a[k].bitwiseAND(b[k])) for k in range(words)), F.lit(0))
    either = sum((F.bit_count(a[k].bitwiseOR(b[k])) for k in range(words)), F.lit(0))
    return both / F.nullif(either, F.lit(0))


def distribution(a: str | Column) -> Column:
    """Negative parts cut off, the rest summing to 1; null without mass."""
    cut = F.transform(col(a).cast("array<double>"), lambda x: F.greatest(x, F.lit(0.0)))
    mass = F.nullif(total(cut), F.lit(0.0))
    return F.when(mass.isNotNull(), F.transform(cut, lambda x: x / mass))


def js_of_distributions(p: str | Column, q: str | Column) -> Column:
    """Jensen-Shannon divergence in bits, within 0 and 1, of arrays that are distributions already; null where either is null."""
    p, q = col(p), col(q)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: 0.5 * part(x, (x + y) / 2) + 0.5 * part(y, (x + y) / 2))
    return F.when(p.isNotNull() & q.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(terms))))


def js_divergence(a: str | Column, b: str | Column) -> Column:
    """The same of arrays of any mass; null where either has none."""
    return js_of_distributions(distribution(a), distribution(b))


def js_similarity(a: str | Column, b: str | Column) -> Column:
    return 1 - js_divergence(a, b)


def warp(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Average cost of the cheapest warping path of each pair of rows; of equally cheap paths the shortest.

    The cells of an anti-diagonal do not depend on each other, so each is one step over all pairs; diagonals are indexed by the place in x.
    """
    rows, n = x.shape
    m = y.shape[1]
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T[::-1])
    blank = lambda: (np.full((n + 1, rows), np.inf), np.zeros((n + 1, rows), np.float32))
    (far, far_steps), (near, near_steps) = blank(), blank()
    far[0] = 0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        slanted, down, across = far[lo - 1 : hi - 1], near[lo - 1 : hi - 1], near[lo:hi]
        least = np.minimum(np.minimum(slanted, down), across)
        taken = np.where(slanted == least, far_steps[lo - 1 : hi - 1], np.inf)
        for cost, steps in ((down, near_steps[lo - 1 : hi - 1]), (across, near_steps[lo:hi])):
            np.minimum(taken, steps, out=taken, where=cost == least)
        (far, far_steps), (near, near_steps) = (near, near_steps), blank()
        near[lo:hi] = least + np.abs(x[lo - 1 : hi - 1] - y[m - d + lo : m - d + hi])
        near_steps[lo:hi] = taken + 1
    return near[n] / near_steps[n]


def dtw_average_distance(a: str | Column, b: str | Column) -> Column:
    """Dynamic time warping with absolute cost, divided by the path's length; null where either array is null or empty. The rows of a batch are warped together."""
    return F.arrow_udf(_warped, DoubleType())(*[col(c).cast("array<double>") for c in (a, b)])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of the lists of an Arrow array; null lists have length 0."""
    offsets = lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return lists.values.to_numpy(zero_copy_only=False), offsets[:-1], np.where(valid, np.diff(offsets), 0)


def _warped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        (x, x_at, n), (y, y_at, m) = _flat(a), _flat(b)
        have, out = (n > 0) & (m > 0), np.zeros(len(a))
        for i, j in np.unique(np.stack([n, m], axis=1)[have], axis=0):
            rows = np.flatnonzero((n == i) & (m == j))
            for k in range(0, len(rows), 512):
                part = rows[k : k + 512]
                out[part] = warp(x[x_at[part, None] + np.arange(i)], y[y_at[part, None] + np.arange(j)])
        yield pa.array(out, mask=~have)


def weighted_available(scores: list[tuple[str | Column, float]]) -> tuple[Column, Column]:
    """Weighted mean of the scores that are not null and have a positive weight, and the weights' sum; a missing score leaves both sums."""
    used = [(col(s), w) for s, w in scores if w > 0]
    mass = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in used), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in used), F.lit(0.0))
    return value / F.nullif(mass, F.lit(0.0)), mass


def combine(a: str | Column, b: str | Column, wa: float = 0.5, wb: float = 0.5) -> Column:
    """Weighted mean of two scores, or the one that is there."""
    a, b = col(a), col(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((wa * a + wb * b) / (wa + wb))


def normalized(a: str | Column) -> Column:
    """The unit vector; a vector of norm 0 stays."""
    a = col(a).cast("array<double>")
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def has_signal(a: str | Column, least: float = 1e-12) -> Column:
    return F.coalesce(F.exists(col(a), lambda x: F.abs(x) > least), F.lit(False))


def padded(a: str | Column, size: int) -> Column:
    """Null is zeros; short arrays get zeros at the end."""
    a = F.coalesce(col(a).cast("array<double>"), F.array().cast("array<double>"))
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def fused(embedding: str | Column, numeric: str | Column, size: int) -> Column:
    """Early fusion: the embedding, padded to `size`, and then the numeric vector."""
    return F.concat(padded(embedding, size), col(numeric).cast("array<double>"))
