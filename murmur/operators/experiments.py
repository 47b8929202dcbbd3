"""Error analysis, the logistic reranker, sweeps, supervised and clustering baselines, walks, and the viewer's tables."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.operators import community, evaluate, features, graph
from murmur.sources.shared import numbered, written

# --- error analysis ----------------------------------------------------------------------------------------------------------------------


def error_analysis(predictions: DataFrame, table: DataFrame, signals: Sequence[str], split: str = "test", top: int = 100) -> dict[str, DataFrame]:
    """Largest errors, least certain rows, counts per community, and mean signals of each kind of error, for one split."""
    rows = evaluate.errors(predictions.where(F.col("split") == split)).join(table.select("user_id", *signals), "user_id", "left").na.fill(0.0, list(signals))
    worst = lambda kind: rows.where(F.col("error_type") == kind).orderBy(F.col("margin").desc(), "user_id").limit(top)
    per = rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error_type") == "FP").alias("fp"), F.count_if(F.col("error_type") == "FN").alias("fn"))
    means = rows.where("error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in signals])
    return {"false_positives": worst("FP"), "false_negatives": worst("FN"), "uncertain": rows.orderBy("margin", "user_id").limit(top), "communities": per, "signals": means}


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per key and cell of the confusion table (TP, FP, FN, TN; bots are positive): the labelled rows in it. Empty cells have no row."""
    said = F.when(F.col("predicted_label") == "bot", "P").otherwise("N")
    right = F.when(F.col("predicted_label") == F.col("label"), "T").otherwise("F")
    rows = predictions.where(F.col("label").isin("bot", "human")).withColumn("outcome", F.concat(right, said))
    return rows.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def changed_predictions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Users of both predictions with outcome: fixed, regressed, unchanged_wrong or unchanged_right."""
    a = before.select("user_id", "split", "label", "community_id", F.col("predicted_label").alias("before"))
    rows = a.join(after.select("user_id", F.col("predicted_label").alias("after")), "user_id").where(F.col("label").isin("bot", "human"))
    was, is_ = F.col("before") == F.col("label"), F.col("after") == F.col("label")
    return rows.withColumn("outcome", F.when(~was & is_, "fixed").when(was & ~is_, "regressed").when(~was, "unchanged_wrong").otherwise("unchanged_right"))


def change_summary(changes: DataFrame, by: Sequence[str] = ("community_id",)) -> DataFrame:
    """Per key: rows, fixed, regressed, net gain and error rates before and after."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    out = changes.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), n("fixed").alias("fixed"), n("regressed").alias("regressed"), n("unchanged_wrong").alias("unchanged_wrong"))
    out = out.withColumn("net_gain", F.col("fixed") - F.col("regressed"))
    return out.withColumn("error_rate_before", (F.col("fixed") + F.col("unchanged_wrong")) / F.col("rows")).withColumn("error_rate_after", (F.col("regressed") + F.col("unchanged_wrong")) / F.col("rows"))


# --- logistic reranker -------------------------------------------------------------------------------------------------------------------


def logistic_gradient_descent(rows: DataFrame, dims: int, rate: float = 0.05, epochs: int = 300, l2: float = 0.001, patience: int = 25) -> tuple[list[float], float, int]:
    """Full-batch gradient descent from zero on (split, y, z): weights, bias and epochs run. L2 on weights only; the weights of the least valid loss are kept.

    Rows are packed once into matrices of one task each. An epoch is one pass over these in which tasks add up gradients; the driver sees a row of
    dims + 4 sums a task.
    """
    rows = rows.where("split in ('train', 'valid')").select((F.col("split") == "train").cast("double").alias("train"), F.col("y").cast("double").alias("y"), "z")
    packed = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(partial(_packed, dims=dims), "rows binary").cache()
    w, b = np.zeros(dims), 0.0
    best, best_loss, stale, epoch = (w, b), np.inf, 0, 0

    def one_pass(grad_w: np.ndarray, grad_b: float) -> tuple[np.ndarray, float, float, float, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dims + 4)
            for batch in batches:
                for block in batch["rows"]:
                    m = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, dims + 2)
                    train, y, x = m[:, 0] == 1, m[:, 1], m[:, 2:]
                    p = 1 / (1 + np.exp(-np.clip(x @ grad_w + grad_b, -500, 500)))
                    q = np.clip(p, 1e-8, 1 - 1e-8)
                    loss = -(y * np.log(q) + (1 - y) * np.log(1 - q))
                    total += np.concatenate([(p - y)[train] @ x[train], [(p - y)[train].sum(), train.sum(), loss[~train].sum(), (~train).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        r = np.sum([np.zeros(dims + 4), *(x.sums for x in packed.mapInArrow(run, "sums array<double>").collect())], axis=0)
        return r[:dims], float(r[dims]), float(r[dims + 1]), float(r[dims + 2]), float(r[dims + 3])

    for epoch in range(1, epochs + 2):  # a pass gives the gradient at the weights and the valid loss of the step before
        g, gb, n, loss, m = one_pass(w, b)
        if epoch > 1:
            now = loss / m if m else 0.0
            if now + 1e-9 < best_loss:
                best, best_loss, stale = (w, b), now, 0
            else:
                stale += 1
                if stale >= patience:
                    break
        if epoch > epochs:
            break
        w, b = w - rate * (g / max(n, 1) + l2 * w), b - rate * gb / max(n, 1)
    packed.unpersist()
    return best[0].tolist(), best[1], epoch - 1


def _packed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Batches of (train, y, z) as one matrix of doubles each."""
    for batch in batches:
        if batch.num_rows:
            z = batch["z"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            m = np.column_stack([batch["train"].to_numpy(zero_copy_only=False), batch["y"].to_numpy(zero_copy_only=False), z]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], ["rows"])


def probability(z: str, weights: list[float], bias: float) -> Column:
    logit = F.aggregate(F.zip_with(F.col(z), F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-logit))


def threshold_search(predictions: DataFrame, thresholds: Sequence[float], split: str = "valid") -> DataFrame:
    """One row per threshold: precision, recall, F1 and AUC on a split (train, if it has no rows), best first: F1, AUC, nearness to one half."""
    used = predictions.where(F.col("label").isin("bot", "human")).where(F.col("split").isin(split, "train"))
    have = used.agg(F.max(F.col("split") == split).alias("_has"))  # one row
    used = used.join(F.broadcast(have)).where((F.col("split") == split) | ~F.col("_has")).drop("_has")
    at = used.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    p, y = F.col("bot_score") >= F.col("threshold"), F.col("label") == "bot"
    c = at.groupBy("threshold").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    c = c.join(F.broadcast(evaluate.auc(used)))  # one row
    order = Window.orderBy(F.col("f1").desc(), F.col("auc").desc(), F.abs(F.col("threshold") - 0.5), "threshold")  # as many rows as thresholds
    return c.withColumn("place", F.row_number().over(order))


def rerank(table: DataFrame, columns: Sequence[str], thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5), **options: float) -> dict:
    """table: user_id, split, label, community_id and numeric columns. z-scores fitted on train rows, logistic model, threshold chosen on valid rows."""
    labelled = table.where(F.col("label").isin("bot", "human"))
    scaled = features.zscores(labelled, columns, F.col("split") == "train", 0.0, "zero").withColumn("y", (F.col("label") == "bot").cast("double"))
    weights, bias, epochs = logistic_gradient_descent(scaled, len(columns), **options)
    scored = scaled.withColumn("bot_score", probability("z", weights, bias)).drop("z", "y")
    search = threshold_search(scored, thresholds)
    cut = search.where("place = 1").first().threshold
    predictions = scored.withColumn("predicted_label", F.when(F.col("bot_score") >= cut, "bot").otherwise("human"))
    return {"weights": dict(zip(columns, weights, strict=True)), "bias": bias, "epochs": epochs, "threshold": cut, "thresholds": search, "predictions": predictions}


# --- supervised and clustering baselines -------------------------------------------------------------------------------------------------

#: Parts of the vectors that k-means passes over: tasks a pass.
KMEANS_PARTS = 24


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("user_id", "split", "label", "community_id")) -> list[str]:
    return [c for c, kind in df.dtypes if c not in exclude and kind in ("int", "bigint", "smallint", "tinyint", "float", "double")]


def labelled_rows(table: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """table's rows with the label and split of the maps, or their own; only bots and humans with a split."""
    rows = evaluate.normalize_assignments(table.withColumn("community_id", F.lit("-")), labels, splits).drop("community_id")
    return rows.where(F.col("label").isin("bot", "human") & F.coalesce(F.col("split") != "", F.lit(False)))


def matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    clean = rows.select("user_id", "split", "label", *[N.to_float(c).alias(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol="raw").transform(clean).withColumn("y", (F.col("label") == "bot").cast("double"))


def _fit(model, data: DataFrame, name: str) -> DataFrame:
    scored = model.fit(data.where("split = 'train'")).transform(data)
    score = vector_to_array("probability")[1]
    return scored.select("user_id", "split", "label", score.alias("bot_score"), F.when(F.round(score, 8) >= 0.5, "bot").otherwise("human").alias("predicted_label"), F.lit(name).alias("model"))


def _best(candidates: dict[str, DataFrame]) -> tuple[str, DataFrame, DataFrame]:
    """The candidate with the best valid F1, AUC and precision; the first of equals. Candidates are a driver's list of models, not rows."""
    rows = []
    for k, (name, df) in enumerate(candidates.items()):
        candidates[name] = df = written(df, "baseline")
        m = evaluate.binary_metrics(df).where("split = 'valid'").first()
        rows.append(((m.f1, m.auc, m.precision, -k) if m else (0.0, 0.0, 0.0, -k), name))
    name = max(rows)[1]
    return name, candidates[name], evaluate.binary_metrics(candidates[name])


def class_weight(data: DataFrame) -> Column:
    """The weight of each row by its class, such that both classes of the train rows weigh the same."""
    r = data.where("split = 'train'").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, p = r.n, r.p or 0.0
    return F.when(F.col("y") == 1, n / (2 * max(p, 1.0))).otherwise(n / (2 * max(n - p, 1.0)))


def logistic_grid(data: DataFrame, strengths: Sequence[float] = (0.1, 1.0, 10.0), balanced: Sequence[bool] = (False, True), vector: str = "raw") -> tuple[str, DataFrame, DataFrame]:
    """Logistic regression over standardised features for each C and class weighting."""
    scaled = StandardScaler(inputCol=vector, outputCol="scaled", withMean=True).fit(data.where("split = 'train'")).transform(data)
    n, weight, out = data.where("split = 'train'").count(), class_weight(data), {}
    for c, even in itertools.product(strengths, balanced):
        rows = scaled.withColumn("w", weight if even else F.lit(1.0))
        model = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="w", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=200)
        out[f"lr_c{c:g}{'_balanced' if even else ''}"] = _fit(model, rows, f"lr_c{c:g}")
    return _best(out)


def forest_grid(data: DataFrame, trees: Sequence[int] = (200, 500), depths: Sequence[int | None] = (8, 16, None), balanced: Sequence[bool] = (False, True), seed: int = 42) -> tuple[str, DataFrame, DataFrame]:
    """Random forests for each size, depth and class weighting; an unbounded depth is Spark's largest, 30."""
    weight, out = class_weight(data), {}
    for n, depth, even in itertools.product(trees, depths, balanced):
        name = f"rf_{n}_{depth}{'_balanced' if even else ''}"
        rows = data.withColumn("w", weight if even else F.lit(1.0))
        out[name] = _fit(RandomForestClassifier(featuresCol="raw", labelCol="y", weightCol="w", numTrees=n, maxDepth=depth or 30, seed=seed), rows, name)
    return _best(out)


def kmeans_groups(data: DataFrame, k: int, starts: int = 10, seed: int = 42, scaled: bool = False, vector: str = "raw", parts: int = KMEANS_PARTS) -> DataFrame:
    """(user_id, community_id) of the start with the least cost. Features are unscaled unless asked, as the published baseline has them.

    Every task of every iteration of every start answers to the driver, so vectors are dealt to a fixed number of parts by user, whatever the
    input's files. First centres are drawn by part and order, which are so the same for the same rows.
    """
    rows = StandardScaler(inputCol=vector, outputCol="_v", withMean=True).fit(data).transform(data) if scaled else data.withColumn("_v", F.col(vector))
    vectors = rows.select("user_id", "_v").repartition(parts, "user_id").sortWithinPartitions("user_id").select("_v").cache()
    models = [KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed + s).fit(vectors) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    vectors.unpersist()
    return best.transform(rows).select("user_id", "split", "label", F.format_string("k%04d", "cluster").alias("community_id"))


def kmeans_baseline(data: DataFrame, ks: Sequence[int] = (32, 64, 128, 256, 512, 898), **options) -> tuple[int, DataFrame]:
    """The number of groups with the best valid F1, AUC and purity of the majority labels, and its assignments."""
    scored = []
    for k in ks:
        rows = written(kmeans_groups(data, k, **options), "kmeans")
        result = evaluate.evaluate_partition(rows)
        m, purity = result["metrics"].where("split = 'valid'").first(), result["purity"].first().global_purity
        scored.append(((m.f1, m.auc, purity) if m else (0.0, 0.0, purity), -k, rows))
    best = max(scored, key=lambda x: x[:2])
    return -best[1], best[2]


def baseline_summary(results: dict[str, DataFrame]) -> DataFrame:
    """One wide row per method: metrics of each split."""
    out = None
    for name, metrics in results.items():
        row = sweep_row(metrics).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


# --- walks -------------------------------------------------------------------------------------------------------------------------------

#: Directed edges of a graph that each task of walks() holds, 600 MB; nodes whose walks it makes at once; neighbours it weighs at once.
WALK_EDGES, WALK_BLOCK, WALK_CELLS = 150_000_000, 2_000, 1_000_000


def walk_graph(follows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, neighbours): the follow graph of labelled users, undirected, without self-loops; neighbours sorted."""
    ids = labelled.select("user_id").distinct()
    rows = follows.where("source <> target").join(ids.withColumnRenamed("user_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("user_id", "target"), "target", "left_semi")
    both = rows.select("source", "target").unionByName(rows.selectExpr("target as source", "source as target")).distinct()
    return both.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list("target")).alias("neighbours"))


def walks(near: DataFrame, number: int = 10, length: int = 40, seed: int = 42, p: float = 1.0, q: float = 1.0, stride: int = 10) -> DataFrame:
    """(node, nth, walk): `number` walks of `length` nodes from each node; with p = q = 1 uniform, else biased: 1/p back, 1 to a common neighbour, 1/q on.

    Neighbours are taken in the order of their ids; a hash of seed, start, walk and step picks one, so walks don't depend on partitioning. Each
    task gets the whole graph as numbers once and walks from its own nodes, so that no step moves anything. A graph of more than WALK_EDGES
    directed edges is walked in joins.
    """
    near = written(near.select("node", F.coalesce("neighbours", F.array().cast(near.schema["neighbours"].dataType)).alias("neighbours")), "walk-graph")
    edges = near.agg(F.sum(F.size("neighbours")).alias("m")).first().m or 0
    if edges > WALK_EDGES:
        return _walks_in_joins(near, number, length, seed, p, q, stride)
    links = near.select("node", F.explode("neighbours").alias("other"))
    ids = numbered(near.select("node").unionByName(links.select(F.col("other").alias("node"))).distinct(), "node")
    ids = written(ids, "walk-nodes")
    lists = links.join(ids.withColumnsRenamed({"node": "other", "number": "_to"}), "other").join(ids, "node").groupBy("number").agg(F.array_sort(F.collect_list("_to")).alias("near"))
    rows = ids.join(near.select("node", F.lit(True).alias("starts")), "node", "left").join(lists, "number", "left")
    tasks = near.sparkSession.sparkContext.defaultParallelism
    kind, nodes = near.schema["node"].dataType.simpleString(), ids.count()
    walk = partial(_walk, nodes=nodes, edges=edges, tasks=tasks, number=number, length=length, seed=seed, p=p, q=q)
    return graph.copied(rows.select("number", "node", F.coalesce("starts", F.lit(False)).alias("starts"), F.coalesce("near", F.array().cast("array<int>")).alias("near")), tasks).mapInArrow(walk, f"node {kind}, nth int, walk array<{kind}>")


def _walk(batches: Iterator[pa.RecordBatch], nodes: int, edges: int, tasks: int, number: int, length: int, seed: int, p: float, q: float) -> Iterator[pa.RecordBatch]:
    """The walks of one task from a whole graph's rows (number, node, starts, near, _task)."""
    first, degree, flat, starts = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.empty(edges, np.int32), np.zeros(nodes, bool)
    names, places, filled, task = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, near = batch["number"].to_numpy(), batch["near"]
        offsets = near.offsets.to_numpy()
        size = np.diff(offsets)
        first[at], degree[at] = filled + offsets[:-1] - offsets[0], size
        flat[filled : filled + size.sum()] = near.values.to_numpy()[offsets[0] : offsets[-1]]
        starts[at] = batch["starts"].to_numpy(zero_copy_only=False)
        names.append(batch["node"])
        places.append(at)
        filled, task = filled + int(size.sum()), batch["_task"][0].as_py()
    if task is None:
        return
    node = pa.concat_arrays(names).take(pa.array(np.argsort(np.concatenate(places))))
    own = np.flatnonzero(starts)
    own = own[own % tasks == task]
    for lo in range(0, len(own), WALK_BLOCK):
        start = np.repeat(own[lo : lo + WALK_BLOCK], number)
        nth = np.tile(np.arange(1, number + 1, dtype=np.int32), len(start) // number)
        text = [f"{seed}|{x}|{k}|".encode() for x, k in zip(node.take(pa.array(start)).cast(pa.string()).to_pylist(), nth.tolist(), strict=True)]
        trace, steps = np.empty((len(start), length), np.int32), np.ones(len(start), np.int64)
        trace[:, 0], going = start, np.arange(len(start))
        for step in range(1, length):
            going = going[degree[trace[going, step - 1]] > 0]
            if not len(going):
                break
            now, end = trace[going, step - 1].astype(np.int64), str(step).encode()
            h = np.array([int.from_bytes(hashlib.sha1(text[k] + end).digest()[:6], "big") for k in going.tolist()], np.int64)
            if p == q == 1.0:
                place = h % degree[now]
            else:
                place = _biased(first, degree, flat, now, trace[going, step - 2].astype(np.int64) if step > 1 else None, h / float(16**12), p, q)
            trace[going, step] = flat[first[now] + place]
            steps[going] += 1
        ends = np.concatenate([[0], np.cumsum(steps)]).astype(np.int32)
        found = node.take(pa.array(trace[np.arange(length) < steps[:, None]]))
        yield pa.RecordBatch.from_arrays([node.take(pa.array(start)), pa.array(nth), pa.ListArray.from_arrays(pa.array(ends), found)], ["node", "nth", "walk"])


def _biased(first: np.ndarray, degree: np.ndarray, flat: np.ndarray, now: np.ndarray, before: np.ndarray | None, share: np.ndarray, p: float, q: float) -> np.ndarray:
    """For each walk the place of the first neighbour whose cumulated weight is more than its share of all weights. Walks of like degrees are
    laid out as a matrix of some million cells; neighbours are sorted, so those in common are found by binary search."""
    place, nodes = np.empty(len(now), np.int64), len(degree)
    order = np.argsort(degree[now], kind="stable")
    reach = degree[now[order]] if before is None else degree[now[order]] + degree[before[order]]
    lo = 0
    while lo < len(order):
        # as many walks as have WALK_CELLS neighbours, one at least; the widest of them is the last
        hi = lo + max(1, int(np.searchsorted(np.cumsum(reach[lo : lo + WALK_CELLS]), WALK_CELLS)))
        part = order[lo:hi]
        size = degree[now[part]]
        column = np.arange(int(size.max()))
        inside = column < size[:, None]
        other = flat[np.where(inside, first[now[part]][:, None] + column, 0)].astype(np.int64)
        if before is None:
            weight = inside.astype(np.float64)
        else:
            last = before[part]
            reached = degree[last]
            owner = np.repeat(np.arange(len(part)), reached)
            known = owner * nodes + flat[first[last][owner] + np.arange(int(reached.sum())) - (np.cumsum(reached) - reached)[owner]]
            key = np.arange(len(part))[:, None] * nodes + other
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            common = known[at] == key if len(known) else np.zeros(key.shape, bool)
            weight = np.where(inside, np.where(other == last[:, None], 1 / p, np.where(common, 1.0, 1 / q)), 0.0)
        grown = np.cumsum(weight, axis=1)
        passed = (grown <= (grown[:, -1] * share[part])[:, None]) & inside
        place[part] = np.minimum(passed.sum(axis=1), size - 1)
        lo = hi
    return place


def _walks_in_joins(near: DataFrame, number: int, length: int, seed: int, p: float, q: float, stride: int) -> DataFrame:
    """The same walks of any graph: all of them step at once, a join a step on the walk's last node. Every `stride` steps the walks so far are a table in the shared folder."""
    near = near.withColumn("neighbours", F.array_sort("neighbours"))
    rows = near.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(number))).alias("nth")).withColumn("walk", F.array("start"))
    biased = p != 1.0 or q != 1.0
    for step in range(1, length):
        at = rows.withColumn("_at", F.element_at("walk", -1)).join(near.withColumnsRenamed({"node": "_at", "neighbours": "_next"}), "_at", "left")
        h = F.conv(F.substring(N.stable_hexdigest(seed, "start", "nth", F.lit(step)), 1, 12), 16, 10).cast("long")
        if not biased:
            choice = F.element_at("_next", (h % F.size("_next") + 1).cast("int"))
        else:
            at = at.withColumn("_prev", F.try_element_at("walk", F.lit(-2))).join(near.withColumnsRenamed({"node": "_prev", "neighbours": "_before"}), "_prev", "left")
            # intersected once by hash: only what is common is searched for each neighbour
            weight = lambda x: F.when(F.col("_prev").isNull(), 1.0).when(x == F.col("_prev"), 1 / p).when(F.array_contains("_common", x), 1.0).otherwise(1 / q)
            at = at.withColumn("_common", F.array_intersect("_next", "_before")).withColumn("_weights", F.transform("_next", weight))
            at = at.withColumn("_cut", F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x) * (h / F.lit(float(16**12))))
            found = F.aggregate(
                F.arrays_zip("_next", "_weights"), F.struct(F.lit(0.0).alias("s"), F.element_at("_next", -1).alias("c"), F.lit(False).alias("done")),
                lambda s, x: F.struct((s["s"] + x["_weights"]).alias("s"), F.when(s["done"] | (s["s"] + x["_weights"] <= F.col("_cut")), s["c"]).otherwise(x["_next"]).alias("c"), (s["done"] | (s["s"] + x["_weights"] > F.col("_cut"))).alias("done")),
                lambda s: s["c"],
            )
            choice = found
        rows = at.select("start", "nth", F.when(F.coalesce(F.size("_next"), F.lit(0)) > 0, F.array_append("walk", choice)).otherwise(F.col("walk")).alias("walk"))
        if step % stride == 0:
            rows = written(rows, "walks")
    return rows.select(F.col("start").alias("node"), "nth", "walk")


def walk_embeddings(found: DataFrame, dim: int = 128, window: int = 5, epochs: int = 5, seed: int = 42) -> DataFrame:
    """(user_id, embedding) by skip-gram over walks."""
    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=0, seed=seed, inputCol="walk", outputCol="_v").fit(found.withColumn("walk", F.transform("walk", lambda x: x.cast("string"))))
    return model.getVectors().select(F.col("word").alias("user_id"), vector_to_array("vector").alias("embedding"))


def walk_baseline(follows: DataFrame, labelled: DataFrame, settings: Sequence[tuple[float, float]] = ((1.0, 1.0),), **options) -> tuple[str, DataFrame, DataFrame]:
    """Logistic regression over walk embeddings; with several (p, q), the best on valid rows."""
    near = written(walk_graph(follows, labelled), "walk-graph")
    out = {}
    for p, q in settings:
        vectors = walk_embeddings(walks(near, p=p, q=q), **options)
        data = labelled.select("user_id", "split", "label").join(vectors, "user_id")
        dims = len(vectors.first().embedding)
        data = VectorAssembler(inputCols=[f"e{k}" for k in range(dims)], outputCol="raw").transform(data.select("user_id", "split", "label", *[F.col("embedding")[k].alias(f"e{k}") for k in range(dims)]))
        out[f"p{p:g}_q{q:g}"] = logistic_grid(data.select("user_id", "split", "label", "raw", (F.col("label") == "bot").cast("double").alias("y")))[1]
    return _best(out)


# --- sweep, choice, viewer ---------------------------------------------------------------------------------------------------------------


def sweep_row(metrics: DataFrame, splits: Sequence[str] = ("all", "train", "valid", "test")) -> DataFrame:
    """The metrics of all splits as one wide row."""
    pick = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
    return metrics.agg(*[pick(s, m) for s in splits for m in ("labeled", "accuracy", "precision", "recall", "f1", "auc")])


def sweep(scored: DataFrame, nodes: DataFrame, rows: DataFrame, ks: Sequence[int] = (5, 10, 15), least_similarities: Sequence[float] = (0.0, 0.05), least_sizes: Sequence[int] = (1, 3, 5),
          thresholds: Sequence[float] = (0.2, 0.3, 0.4, 0.5), algorithms: Sequence[str] = ("structural_entropy",), done: Sequence[str] = (), report: Callable[[dict], None] | None = None,
          keep: Callable[[dict, dict[str, DataFrame]], None] | None = None) -> list[dict]:
    """All combinations, best valid F1 first. scored pairs are computed once; graphs are shared by (k, similarity), communities by (…, size). `done` names are skipped.

    report gets each run's row, keep also its tables: assignments, profiles, predictions, metrics.
    """
    pairs = written(scored, "scored")
    out = []
    for k, similarity in itertools.product(ks, least_similarities):
        edges = written(graph.mutual_bonus(graph.symmetrize(graph.directed_topk(pairs, k, similarity))).select("a", "b", "weight"), "edges")
        for algorithm, size in itertools.product(algorithms, least_sizes):
            names = {t: f"{algorithm}_k{k}_s{similarity:g}_m{size}_t{t:g}" for t in thresholds}
            if all(n in done for n in names.values()):
                continue
            labels = written(community.detect(edges, nodes, algorithm, least=size), "labels")
            assigned = rows.drop("community_id").join(labels.selectExpr("node as user_id", "community as community_id"), "user_id")
            for t, name in names.items():
                if name in done:
                    continue
                result = evaluate.evaluate_partition(assigned, t, by_majority=False)
                row = {"name": name, "k": k, "similarity": similarity, "least_size": size, "threshold": t, "communities": result["profiles"].count(), **sweep_row(result["metrics"]).first().asDict()}
                out.append(row)
                if report:
                    report(row)
                if keep:
                    keep(row, {"assignments": assigned, **result})
    return rank_runs(out)


def rank_runs(runs: list[dict], objective: str = "valid_f1") -> list[dict]:
    return sorted(runs, key=lambda r: (-(r.get(objective) or 0.0), -(r.get("valid_auc") or 0.0), r["communities"], r["name"]))


def finalize(runs: list[dict], top: int = 20) -> dict:
    """The best run and the leading ones."""
    ranked = rank_runs(runs)
    return {"best": ranked[0] if ranked else None, "top": ranked[:top]}


def extreme_communities(profiles: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The communities with the highest and the lowest scores; of equal scores the larger, then by id, reversed for the lowest."""
    keys = [F.col("bot_score"), F.col("community_size"), F.col("community_id")]
    return {"bot": profiles.orderBy(*[k.desc() for k in keys]).limit(n), "human": profiles.orderBy(*[k.asc() for k in keys]).limit(n)}


def community_links(edges: DataFrame, labels: DataFrame, channels: Sequence[str] = ()) -> DataFrame:
    """Per pair of different communities: edges, mean weight, and each channel's mean over edges that have it."""
    ends = edges.join(labels.selectExpr("node as a", "community as ca"), "a").join(labels.selectExpr("node as b", "community as cb"), "b").where("ca <> cb")
    return ends.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("mean_weight"), *[F.avg(c).alias(f"mean_{c}") for c in channels])


def top_members(rows: DataFrame, n: int = 6) -> DataFrame:
    """Per community the n users with most followers, then tweets, then id, as an array."""
    order = Window.partitionBy("community_id").orderBy(F.col("followers_count").desc(), F.col("tweets").desc(), "user_id")
    top = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return top.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "user_id"))), lambda x: x["user_id"]).alias("members"))


def spiral_layout(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), step: float = 10.0) -> DataFrame:
    """rows with x and y on a sunflower spiral by rank: the golden angle apart, at a radius of step times the rank's root."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w) - 1)
    angle, radius = F.col("_n") * float(np.pi * (3 - 5**0.5)), step * F.sqrt(F.col("_n") + 0.5)
    return ranked.withColumn("x", radius * F.cos(angle)).withColumn("y", radius * F.sin(angle)).drop("_n")


def search(rows: DataFrame, text: str, columns: Sequence[str], limit: int = 12, order: str = "user_id") -> DataFrame:
    """The first rows that have the text in one of some columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return rows.where(hit).orderBy(order).limit(limit)


def bundle(users: DataFrame, edges: DataFrame, labels: DataFrame, profiles: DataFrame, predictions: DataFrame, channels: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The viewer's tables: communities with layout and members, links between them, users, errors, and an overview row."""
    members = top_members(users.join(labels.selectExpr("node as user_id", "community as community_id"), "user_id"))
    laid = spiral_layout(profiles.join(members, "community_id", "left"), [F.col("community_size").desc(), F.col("community_id")], step=40.0)
    overview = profiles.agg(F.count(F.lit(1)).alias("communities"), F.sum("community_size").alias("users"), F.max("community_size").alias("largest")).join(evaluate.global_purity(profiles))  # one row each
    return {"communities": laid, "links": community_links(edges, labels, channels), "users": predictions, "errors": evaluate.errors(predictions).where("error_type is not null"), "overview": overview}


def verify_bundle(tables: dict[str, DataFrame], claimed: dict[str, float], tolerance: float = 1e-4) -> dict[str, tuple[float, float, bool]]:
    """Recompute counts and purity from a bundle's records and compare them with what it claims."""
    c = tables["communities"]
    r = c.agg(F.count(F.lit(1)).alias("communities"), F.sum("community_size").alias("users"), F.max("community_size").alias("largest"), F.percentile("community_size", F.lit(0.5)).alias("median"), (F.sum(F.col("community_size") * F.col("purity")) / F.sum("community_size")).alias("global_purity")).first().asDict()
    return {k: (float(r[k]), float(v), abs(float(r[k]) - float(v)) <= (0.6 if k == "median" else tolerance)) for k, v in claimed.items() if k in r}
