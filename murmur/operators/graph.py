"""Similarity graphs: exact top-k cosine, candidates, four-channel late fusion, symmetrising and degrees.

The exact all-pairs search deals the vectors to as many blocks as there are tasks. All vectors pass through each task in the order of their ids, and
the task keeps the k best of its block's vectors, so each vector moves once a task and nothing else does. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import vectors as V
from murmur.sources.shared import numbered, written

#: Vectors of a task's block at most: 131,072 of 64 doubles are 67 MB. Products that a task holds at once.
BLOCK, PRODUCTS = 131_072, 4_000_000
CHANNELS = ("content", "behaviour", "temporal", "network")


def cosine_topk(vectors: DataFrame, k: int, key: str = "id", vector: str = "vector", least: float | None = None, block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """(source, target, weight, rank): each vector's k nearest by cosine, ties by target. Vectors of norm 0 have no neighbours.

    rows: the number of vectors, if known, which saves a count. Sums are in double precision, so equal inputs give equal ranks; equal products may
    differ in the last bits by the block's shape, and twelve places decide ranks.
    """
    n = vectors.count() if rows is None else rows
    tasks = max(1, min(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // block)), n))
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(V.has_signal("v"))
    if dict(own.dtypes)["v"] not in ("array<float>", "array<double>"):
        own = own.withColumn("v", F.col("v").cast("array<double>"))
    kind = own.schema["id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        own = own.withColumn("n", F.col("id").cast("long"))
    else:
        own = written(own, "vectors")
        own = own.join(numbered(own.select("id").distinct(), "id").select("id", F.col("number").cast("long").alias("n")), "id")
    block_rows = own.withColumn("_task", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")).withColumn("_side", F.lit(0))
    all_rows = own.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("_side", F.lit(1))
    dealt = block_rows.unionByName(all_rows).repartitionById(tasks, F.col("_task")).sortWithinPartitions("_side", "n")
    found = dealt.mapInArrow(partial(_nearest, k=k), f"source {kind}, target {kind}, weight double, rank int")
    return found if least is None else found.where(F.col("weight") >= least)


def _matrix(v: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of doubles of norm 1."""
    offsets = v.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    m = v.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(sizes), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best targets of a block's vectors. First come the block's rows (_side 0), then all vectors by their number n.

    As targets come in order, one whose rounded product is not above that of a source's k-th so far can't be among its k best.
    """
    x, ids, numbers, names, passed = [], [], [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        side = batch["_side"].to_numpy()
        cut = int((side == 0).sum())
        if cut:
            x.append(_matrix(batch["v"].slice(0, cut)))
            ids.append(batch["id"].slice(0, cut))
            numbers.append(batch["n"].slice(0, cut).to_numpy())
        if cut == batch.num_rows or not x:
            continue
        if not passed:
            block, mine, source = np.concatenate(x), np.concatenate(numbers), pa.concat_arrays(ids)
            best = _Best(len(block), k)
        y, number = _matrix(batch["v"].slice(cut)), batch["n"].slice(cut).to_numpy()
        if y.shape[1] != block.shape[1]:
            raise ValueError("vectors differ in length")
        lo, times = np.searchsorted(mine, number, "left"), np.searchsorted(mine, number, "right") - np.searchsorted(mine, number, "left")
        mate = np.repeat(np.arange(len(number)), times)  # of which a row of the block has the id
        itself = lo[mate] + np.arange(len(mate)) - (np.cumsum(times) - times)[mate]
        wrong = np.flatnonzero(np.isnan(y[:, 0]))
        step = max(1, PRODUCTS // len(number))
        for at in range(0, len(block), step):
            s = block[at : at + step] @ y.T
            own = slice(*np.searchsorted(itself, [at, at + step]))
            s[itself[own] - at, mate[own]] = -np.inf
            s[:, wrong] = -np.inf
            best.add(s, at, passed)
        names.append(batch["id"].slice(cut))
        passed += len(number)
    if passed:
        row, place, weight, rank = best.ranked()
        target = pa.concat_arrays(names)
        for at in range(0, len(row), 100_000):
            some = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([source.take(pa.array(row[some])), target.take(pa.array(place[some])), pa.array(weight[some]), pa.array(rank[some].astype(np.int32))], ["source", "target", "weight", "rank"])


class _Best:
    """The k best places of each row so far, by rounded weight and then place, which only grows."""

    def __init__(self, rows: int, k: int):
        self.k, self.limit = k, max(rows * k, 1_000_000)
        self.floor = np.full(rows, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, s: np.ndarray, row: int, place: int) -> None:
        floor = self.floor[row : row + len(s)]
        over = s > floor[:, None]
        if np.count_nonzero(over) > 2 * self.k * len(s) and s.shape[1] > self.k:
            edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            over = s > np.maximum(floor, edge - 1e-12)[:, None]
        r, c = np.nonzero(over)
        self.kept.append((r + row, c + place, s[r, c]))
        self.waiting += len(r)
        if self.waiting > self.limit:
            self._merge()

    def _merge(self) -> None:
        if not self.kept:
            self.kept, self.rank = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], np.empty(0, np.int64)
            return
        r, c, w = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((c, -np.round(w, 12), r))
        r, c, w = r[order], c[order], w[order]
        first = np.searchsorted(r, r)
        at = np.arange(len(r)) - first
        keep = at < self.k
        self.kept, self.waiting = [(r[keep], c[keep], w[keep])], 0
        full = at == self.k - 1
        # what rounds to no more than the k-th is no better
        self.floor[r[full]] = np.round(w[full], 12) + 4e-13
        self.rank = at[keep] + 1

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        return *self.kept[0], self.rank


def copied(rows: DataFrame, tasks: int) -> DataFrame:
    """rows once for each of some tasks, whose number is in _task: the partition of that number has them, and nothing else."""
    return rows.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("_task"))


def _union(sources: tuple[DataFrame, ...]) -> DataFrame:
    out = sources[0].select("source", "target")
    for s in sources[1:]:
        out = out.unionByName(s.select("source", "target"))
    return out


def candidates(*sources: DataFrame) -> DataFrame:
    """The union of candidate pairs (source, target), in both directions, without self-loops."""
    out = _union(sources)
    return out.unionByName(out.selectExpr("target as source", "source as target")).where("source <> target").distinct()


def _known(bundles: DataFrame) -> DataFrame:
    """Bundles as a table by number: users and those they follow as numbers in the order of their ids, type mixes as distributions."""
    followed = bundles.select("user_id", F.explode("followed").alias("other"))
    ids = bundles.select("user_id").unionByName(followed.select(F.col("other").alias("user_id"))).distinct()
    ids = written(numbered(ids, "user_id"), "user-numbers")
    sets = followed.join(ids.withColumnsRenamed({"user_id": "other", "number": "_other"}), "other").groupBy("user_id").agg(F.array_sort(F.collect_set("_other")).alias("_set"))
    known = bundles.join(ids, "user_id").join(sets, "user_id", "left")
    sets = F.when(F.col("followed").isNotNull(), F.coalesce("_set", F.array().cast("array<int>")))
    return written(known.select("number", "user_id", "embedding", "behaviour", "degrees_unit", "hours", V.distribution("type_mix").alias("mix"), sets.alias("followed")), "known")


def _by_number(pairs: DataFrame, known: DataFrame) -> DataFrame:
    ids = known.select("user_id", "number")
    out = pairs.select("source", "target").distinct().join(ids.withColumnsRenamed({"user_id": "source", "number": "_s"}), "source").join(ids.withColumnsRenamed({"user_id": "target", "number": "_t"}), "target")
    return out.selectExpr("_s as source", "_t as target")


def score_pairs(pairs: DataFrame, bundles: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Unordered pairs (a, b) with four channels, null where either side lacks one, and the weighted mean of those that are there.

    bundles: user_id, embedding, behaviour, type_mix, hours (null if too few dated tweets), degrees_unit, followed. Each unordered pair
    is scored once; pairs of a user with itself go.
    """
    known = _known(bundles)
    return _scored(_by_number(pairs, known), known, weights)


def _scored(pairs: DataFrame, known: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """score_pairs by numbers. The users are dealt to tasks; a task gets its users' bundles and the pairs (a, b) of its users a, then all bundles pass by
    in order of their numbers. So a bundle moves once a task and a pair moves as two numbers."""
    weights = weights or {c: 0.25 for c in CHANNELS}
    tasks = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // BLOCK))
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("int")), F.lit(tasks)).cast("int")
    parts = known.select(F.struct(*[c for c in known.columns if c != "number"]).alias("bundle"), F.col("number").cast("int").alias("b"))
    none = F.lit(None).cast(parts.schema["bundle"].dataType)
    a, b = F.least("source", "target").cast("int"), F.greatest("source", "target").cast("int")
    own = parts.select(of("b").alias("_task"), F.lit(-1).alias("n"), F.lit(0).alias("_side"), "b", "bundle")
    passing = parts.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), F.col("b").alias("n"), F.lit(2).alias("_side"), "b", "bundle")
    two = pairs.where("source <> target").select(a.alias("b"), b.alias("n"))
    two = two.select(of("b").alias("_task"), "n", F.lit(1).alias("_side"), "b", none.alias("bundle"))
    # first a task's own bundles, then each user's pairs before its bundle
    dealt = own.unionByName(two).unionByName(passing).repartitionById(tasks, F.col("_task")).sortWithinPartitions("n", "_side", "b")
    kind = known.schema["user_id"].dataType.simpleString()
    rows = dealt.mapInArrow(_channels, f"a {kind}, b {kind}, content double, behaviour double, temporal double, network double")
    fused, mass = V.weighted_available([(c, weights[c]) for c in CHANNELS])
    return rows.withColumn("weight", fused).withColumn("available_weight", mass).withColumn("channels", sum((F.col(c).isNotNull().cast("int") for c in CHANNELS), F.lit(0)))


class _Lists:
    """The lists of an Arrow column: values, starts and lengths, and which are not null."""

    def __init__(self, column: pa.Array):
        self.there = column.is_valid().to_numpy(zero_copy_only=False)
        self.start, self.size = column.offsets.to_numpy()[:-1].astype(np.int64), np.where(self.there, np.diff(column.offsets.to_numpy()), 0)
        self.values = column.values.to_numpy(zero_copy_only=False)

    def rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.values[self.start[at][:, None] + np.arange(size)].astype(np.float64, copy=False)


def _by_size(x: _Lists, i: np.ndarray, y: _Lists, j: np.ndarray, value: Callable, same: bool = True) -> np.ndarray:
    """value(rows of x, rows of y) for pairs of lists of the same two sizes, some hundreds at once; NaN where either is null or empty. same: unequal sizes are an error."""
    out, n, m = np.full(len(i), np.nan), x.size[i], y.size[j]
    have = (n > 0) & (m > 0)
    for p, q in np.unique(np.stack([n, m], axis=1)[have], axis=0):
        if same and p != q:
            raise ValueError("vectors differ in length")
        at = np.flatnonzero(have & (n == p) & (m == q))
        for lo in range(0, len(at), 512):
            part = at[lo : lo + 512]
            out[part] = value(x.rows(i[part], p), y.rows(j[part], q))
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(cosine + 1) / 2 within 0 and 1; NaN where a norm is 0."""
    norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    at = norms > 0
    return np.where(at, np.clip(((x * y).sum(axis=1) / np.where(at, norms, 1.0) + 1) / 2, 0.0, 1.0), np.nan)


def _js_similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    mean = np.where(p + q > 0, (p + q) / 2, 1.0)
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0) / mean), 0.0)
    return 1 - np.clip((0.5 * part(p) + 0.5 * part(q)).sum(axis=1), 0.0, 1.0)


def _shared(x: _Lists, i: np.ndarray, y: _Lists, j: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of sorted lists of distinct numbers; NaN where either is null or both are empty."""
    out = np.full(len(i), np.nan)
    size = x.size[i] + y.size[j]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(i):  # as many pairs as have a million numbers, one at least
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
        keys = []
        for lists, at in ((x, i[lo:hi]), (y, j[lo:hi])):
            n = lists.size[at]
            owner = np.repeat(np.arange(len(at)), n)
            keys.append((owner << 32) + lists.values[lists.start[at][owner] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[owner]])
        one, other = keys
        hit = other[np.minimum(np.searchsorted(other, one), max(len(other) - 1, 0))] == one if len(other) else np.zeros(len(one), bool)
        both = np.bincount(one[hit] >> 32, minlength=hi - lo)
        either = size[lo:hi] - both
        out[lo:hi] = np.where(x.there[i[lo:hi]] & y.there[j[lo:hi]] & (either > 0), both / np.maximum(either, 1), np.nan)
        lo = hi
    return out


def _combined(a: np.ndarray, b: np.ndarray, wa: float = 0.5, wb: float = 0.5) -> np.ndarray:
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, (wa * a + wb * b) / (wa + wb)))


def _channels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, channels) of a task's pairs: rows are its own bundles, then by number each user's pairs (a in column b, b in column n) and its bundle."""
    fields = ("embedding", "behaviour", "degrees_unit", "hours", "mix", "followed")
    numbers, own, waiting, block = [], [], np.empty((2, 0), np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        side, n, b = (batch[c].to_numpy() for c in ("_side", "n", "b"))
        cut = int((side == 0).sum())
        if cut:
            numbers.append(b[:cut])
            own.append(batch["bundle"].slice(0, cut))
        if cut == len(side) or not numbers:
            continue
        if block is None:
            mine, order = np.sort(np.concatenate(numbers)), np.argsort(np.concatenate(numbers))
            bundle = pa.concat_arrays(own).take(pa.array(order))
            block, names = {c: _Lists(bundle.field(c)) for c in fields}, bundle.field("user_id")
        two = side == 1
        waiting = np.concatenate([waiting, np.stack([b[two], n[two]]).astype(np.int64)], axis=1)
        passing = np.flatnonzero(side == 2)
        if not len(passing):
            continue
        known = n[passing]
        ready = int(np.searchsorted(waiting[1], known[-1], "right"))
        a, c = waiting[:, :ready]
        waiting = waiting[:, ready:]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])[: len(a)]  # a pair may be there several times
        a, c = a[first], c[first]
        i, j = np.minimum(np.searchsorted(mine, a), len(mine) - 1), np.minimum(np.searchsorted(known, c), len(known) - 1)
        found = (mine[i] == a) & (known[j] == c)
        i, j = i[found], j[found]
        if not len(i):
            continue
        bundle = batch["bundle"].take(pa.array(passing))
        now = {f: _Lists(bundle.field(f)) for f in fields}
        on = lambda f, value, same=True: _by_size(block[f], i, now[f], j, value, same)  # noqa: B023, E731
        channels = {
            "content": on("embedding", _cosines), "behaviour": _combined(on("mix", _js_similarity), on("behaviour", _cosines)), "temporal": 1 / (1 + on("hours", V.warp, False)),
            "network": _combined(_shared(block["followed"], i, now["followed"], j), on("degrees_unit", _cosines), 0.7, 0.3),
        }
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), bundle.field("user_id").take(pa.array(j)), *[pa.array(channels[c], mask=np.isnan(channels[c])) for c in CHANNELS]], ["a", "b", *CHANNELS])


def directed_topk(scored: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """Both directions of scored pairs, each source's k heaviest, ties by target."""
    both = scored.withColumnsRenamed({"a": "source", "b": "target"}).unionByName(scored.withColumnsRenamed({"b": "source", "a": "target"}), allowMissingColumns=False)
    order = Window.partitionBy("source").orderBy(F.col("weight").desc(), "target")
    return both.where(F.col("weight").isNotNull() & (F.col("weight") >= least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def symmetrize(directed: DataFrame, mode: str = "union_max", keep: tuple[str, ...] = ()) -> DataFrame:
    """Undirected (a, b, weight, support), a < b: the larger weight, and how many directions there were; mutual_max needs both, directed keeps all rows as they are."""
    if mode == "directed":
        return directed.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight", F.lit(1).cast("long").alias("support"), *keep)
    if mode not in ("union_max", "mutual_max"):
        raise ValueError(f"unknown mode {mode}")
    out = directed.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    out = out.agg(F.max("weight").alias("weight"), F.count_distinct("source").alias("support"), *[F.max(c).alias(c) for c in keep])
    return out.where("support >= 2") if mode == "mutual_max" else out


def mutual_bonus(edges: DataFrame, bonus: float = 0.1) -> DataFrame:
    """Weights of edges with both directions raised by `bonus`."""
    return edges.withColumn("weight", F.col("weight") * (1 + F.greatest(F.col("support") - 1, F.lit(0)) * bonus))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, weight): both directions of undirected edges."""
    return edges.selectExpr("a as node", "b as other", "weight").unionByName(edges.selectExpr("b as node", "a as other", "weight"))


def degree_summary(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """One row: nodes, edges, average and largest degree, isolated nodes."""
    degree = adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.select(F.col(key).alias("node")).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.agg(F.count(F.lit(1)).alias("nodes"), F.expr("sum(degree) / 2").cast("long").alias("edges"), F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def channel_coverage(scored: DataFrame) -> DataFrame:
    """One row: the share of pairs that have each channel."""
    return scored.agg(*[(F.count(c) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias(c) for c in CHANNELS])


def early_fusion(vectors: DataFrame, k: int, least: float, size: int) -> DataFrame:
    """Top-k cosine over fused vectors, all of one size."""
    right = F.when(F.size("fused") == size, F.col("fused")).otherwise(F.raise_error(F.lit("fused vectors differ in size")).cast("array<double>"))
    return cosine_topk(vectors.select("user_id", right.alias("fused")), k, "user_id", "fused", least)


def late_fusion(bundles: DataFrame, follows: DataFrame, k: int = 10, candidate_k: int = 100, weights: dict[str, float] | None = None, least: float = 0.0, mode: str = "union_max") -> dict[str, DataFrame]:
    """The whole graph build: candidates from content, behaviour and follows; channels; top k; undirected edges. bundles must be cheap to read again."""
    known = _known(bundles)
    content = cosine_topk(known.where("embedding is not null"), candidate_k, "number", "embedding")
    behaviour = cosine_topk(known.where("behaviour is not null"), candidate_k, "number", "behaviour")
    scored = written(_scored(_union((content, behaviour, _by_number(follows, known))), known, weights), "scored")  # warped once
    directed = directed_topk(scored, k, least)
    return {"scored": scored, "directed": directed, "edges": symmetrize(directed, mode, (*CHANNELS, "available_weight"))}


