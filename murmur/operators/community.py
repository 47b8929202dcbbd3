"""Communities: structural entropy and its agglomeration, weighted label propagation, small-community merging, trees and partition quality.

The sequential algorithms only ever relate neighbours, and the one global quantity they use is the graph's volume. So they run per
connected component as grouped functions and give what a run over the whole graph would. `mutual_best` is a separate, approximate
agglomeration in joins for components too large for one task.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.components import components
from murmur.operators.graph import adjacency
from murmur.sources.shared import drop_written, numbered, written

EPS = 1e-12
#: Edges of a component that one task takes: some 2 GB as Python dictionaries.
LARGEST = 4_000_000


def entropy_term(volume: Column, internal: Column, total: Column) -> Column:
    """-(cut/2m) log2(V/2m) + (V/2m) log2 V, 0 for an empty volume; total is 2m."""
    cut = F.greatest(volume - 2 * internal, F.lit(0.0))
    return F.when((volume > 0) & (total > 0), -(cut / total) * F.log2(volume / total) + (volume / total) * F.log2(volume)).otherwise(0.0)


def community_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: size, volume, internal weight and edges. edges (a, b, weight), labels (node, community)."""
    strength = adjacency(edges).groupBy("node").agg(F.sum("weight").alias("strength"))
    sizes = labels.join(strength, "node", "left").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("strength"), F.lit(0.0)).alias("volume"))
    ends = edges.join(labels.selectExpr("node as a", "community as ca"), "a").join(labels.selectExpr("node as b", "community as cb"), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("internal"), F.count(F.lit(1)).alias("internal_edges"))
    return sizes.join(inner, "community", "left").na.fill(0.0, ["internal"]).na.fill(0, ["internal_edges"])


def partition_entropy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: communities and the structural entropy of a partition. Of singletons it is log2(2m)."""
    stats = community_stats(edges, labels)
    total = edges.agg((2 * F.sum("weight")).alias("total"))  # one row
    return stats.join(F.broadcast(total)).agg(F.count(F.lit(1)).alias("communities"), F.sum(entropy_term(F.col("volume"), F.col("internal"), F.col("total"))).alias("entropy"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) of undirected edges. Each edge is directed to its end of larger degree (ties by id), so hubs have short lists."""
    pairs = edges.select("a", "b").distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.selectExpr("node as a", "d as da"), "a").join(degree.selectExpr("node as b", "d as db"), "b")
    up = F.expr("da < db or (da = db and a < b)")
    out = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = out.join(out.selectExpr("x", "y as z"), "x").where("y < z")
    closed = wedge.join(pairs.select(F.least("a", "b").alias("y"), F.greatest("a", "b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: the mean over members of the share of their neighbours within it that are neighbours; 0 for fewer than two neighbours."""
    ends = edges.join(labels.selectExpr("node as a", "community as ca"), "a").join(labels.selectExpr("node as b", "community as cb"), "b")
    inner = ends.where("ca = cb").select("a", "b")
    degree = inner.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    local = labels.join(degree, "node", "left").join(triangles(inner), "node", "left").na.fill(0, ["d", "triangles"])
    share = F.when(F.col("d") >= 2, 2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return local.groupBy("community").agg(F.avg(share).alias("clustering"))


def structure(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: size, internal edges, density, average degree and clustering."""
    stats = community_stats(edges, labels).join(clustering(edges, labels), "community")
    size = F.col("size")
    density = F.when(size > 1, 2 * F.col("internal_edges") / (size * (size - 1))).otherwise(0.0)
    return stats.select("community", "size", "internal_edges", density.alias("density"), (2 * F.col("internal_edges") / size).alias("average_degree"), "clustering")


def partition_quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: communities, largest and median size, structural entropy, weighted modularity, size-weighted density, clustering and conductance."""
    rows = community_stats(edges, labels).join(structure(edges, labels).select("community", "density", "clustering"), "community")
    rows = rows.join(F.broadcast(edges.agg(F.sum("weight").alias("w"))))  # one row
    total, v = 2 * F.col("w"), F.col("volume")
    cut, rest = F.greatest(v - 2 * F.col("internal"), F.lit(0.0)), F.least(v, total - v)
    conductance = F.when(rest > 0, cut / rest).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("size")) / F.sum("size")
    return rows.agg(
        F.count(F.lit(1)).alias("communities"), F.max("size").alias("largest"), F.percentile("size", F.lit(0.5)).alias("median"),
        F.sum(entropy_term(v, F.col("internal"), total)).alias("entropy"), F.sum(F.col("internal") / F.col("w") - F.pow(v / total, F.lit(2.0))).alias("modularity"),
        mean(F.col("density")).alias("density"), mean(F.col("clustering")).alias("clustering"), mean(conductance).alias("conductance"),
    )


# --- sequential algorithms, per component ----------------------------------------------------------------------------------------------


def by_component(edges: DataFrame) -> DataFrame:
    """edges (a, b, weight) with the smallest node of their component. Raises ValueError where a component has more than LARGEST edges, as each meets
    in one task: `mutual_best` is for such graphs."""
    found = components(edges.select("a", "b")).withColumnRenamed("node", "b")
    big = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    rows = written(big.join(found, "b").select("component", "a", "b", "weight"), "components")
    most = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if most > LARGEST:
        raise ValueError(f"a connected component has {most} edges, more than {LARGEST}: use mutual_best")
    return rows


def _neighbours(pdf: pd.DataFrame) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"], strict=True):
        if a != b:
            out[a][b] = out[b][a] = float(w)
    return out


def agglomerate(near: dict[str, dict[str, float]], total: float) -> tuple[dict[str, str], list[tuple]]:
    """Merge the neighbouring communities whose union lowers the entropy most until none does. Returns each node's community and the tree's rows.

    A queued gain stays right, as it depends on two communities that never change, so entries of merged communities are just passed over.
    """
    volume = {x: sum(n.values()) for x, n in near.items()}
    inner = dict.fromkeys(near, 0.0)
    links = {x: dict(n) for x, n in near.items()}
    members = {x: [x] for x in near}

    def term(v: float, w: float) -> float:
        return -(max(v - 2 * w, 0.0) / total) * math.log2(v / total) + (v / total) * math.log2(v) if v > 0 else 0.0

    own = {x: term(volume[x], 0.0) for x in near}

    def gain(x: str, y: str) -> float:
        return own[x] + own[y] - term(volume[x] + volume[y], inner[x] + inner[y] + links[x][y])

    heap = [(-g, x, y) for x in near for y in links[x] if x < y and (g := gain(x, y)) > EPS]
    heapq.heapify(heap)
    tree: list[tuple] = [(f"leaf:{x}", "leaf", x, [], 1, None, None) for x in sorted(near)]
    node = {x: f"leaf:{x}" for x in near}
    entropy, merges = sum(own.values()), 0
    while heap:
        g, x, y = heapq.heappop(heap)
        if x not in links or y not in links:
            continue
        merges += 1
        new = f"merge:{merges:05d}"
        volume[new], inner[new] = volume[x] + volume[y], inner[x] + inner[y] + links[x][y]
        joined: dict[str, float] = defaultdict(float)
        for old in (x, y):
            for z, w in links.pop(old).items():
                if z not in (x, y):
                    joined[z] += w
                    links[z].pop(old, None)
        links[new] = dict(joined)
        for z, w in joined.items():
            links[z][new] = w
        members[new] = members.pop(x) + members.pop(y)
        own[new] = term(volume[new], inner[new])
        entropy += g
        tree.append((new, "merge", None, [node.pop(x), node.pop(y)], len(members[new]), -g, entropy))
        node[new] = new
        for z in joined:
            a, b = min(new, z), max(new, z)
            if (g := gain(a, b)) > EPS:
                heapq.heappush(heap, (-g, a, b))
    return {x: min(m) for m in members.values() for x in m}, tree


def _hash(seed: int, step: int, text: str) -> str:
    return hashlib.sha1(f"{seed}:{step}:{text}".encode()).hexdigest()


class Graph:
    """An undirected graph as arrays: node names in order, and for each node the range of its neighbours and weights."""

    def __init__(self, near: dict[str, dict[str, float]]):
        self.names = sorted(near)
        number = {x: k for k, x in enumerate(self.names)}
        self.degree = np.array([len(near[x]) for x in self.names], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.degree)])
        self.to = np.array([number[y] for x in self.names for y in near[x]], np.int64)
        self.weight = np.array([w for x in self.names for w in near[x].values()], np.float64)

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the neighbours of some nodes, and for each which of the nodes it belongs to."""
        size = self.degree[nodes]
        owner = np.repeat(np.arange(len(nodes)), size)
        return self.start[nodes][owner] + np.arange(int(size.sum())) - (np.cumsum(size) - size)[owner], owner

    def waves(self, order: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes of order in sets without edges inside, each node after all its neighbours that come before it: visiting a set at once is visiting
        its nodes in order."""
        rank = np.full(len(self.names), -1, np.int64)
        rank[order] = np.arange(len(order))
        at, owner = self.spread(order)
        other = rank[self.to[at]]
        waits = np.bincount(owner[(other >= 0) & (other < owner)], minlength=len(order))
        ready = np.flatnonzero(waits == 0)
        while len(ready):
            yield order[ready]
            at, owner = self.spread(order[ready])
            later = rank[self.to[at]]
            later = later[later > ready[owner]]
            np.subtract.at(waits, later, 1)
            later = np.unique(later)
            ready = later[waits[later] == 0]

    def pulls(self, nodes: np.ndarray, label: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which node, label, weight) summed over the neighbours of some nodes, of the allowed labels."""
        at, owner = self.spread(nodes)
        found, weight = label[self.to[at]], self.weight[at]
        if allowed is not None:
            owner, found, weight = (x[allowed[found]] for x in (owner, found, weight))
        key, back = np.unique(owner * len(self.names) + found, return_inverse=True)
        return key // len(self.names), key % len(self.names), np.bincount(back, weight, minlength=len(key))


def _choose(graph: Graph, nodes: np.ndarray, label: np.ndarray, seed: int, step: int, stay: bool, name: Callable[[int], str], allowed: np.ndarray | None = None) -> np.ndarray:
    """Each node's heaviest label: its own, if stay and that is among the heaviest; of several the one with the smallest hash; its own without any."""
    out = label[nodes].copy()
    owner, found, weight = graph.pulls(nodes, label, allowed)
    if not len(owner):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    top = np.repeat(np.maximum.reduceat(weight, first), np.diff(np.append(first, len(owner))))
    best = np.isclose(weight, top, rtol=1e-9, atol=0.0)
    settled = np.zeros(len(nodes), bool)
    if stay:
        settled[owner[best & (found == out[owner])]] = True
    best &= ~settled[owner]
    owner, found = owner[best], found[best]
    many = np.bincount(owner, minlength=len(nodes))[owner] > 1
    out[owner[~many]] = found[~many]
    pick: dict[int, tuple[str, str, int]] = {}
    for o, f in zip(owner[many].tolist(), found[many].tolist(), strict=True):
        key = (_hash(seed, step, f"{graph.names[nodes[o]]}:{name(f)}"), name(f), f)
        pick[o] = min(pick.get(o, key), key)
    for o, (_, _, f) in pick.items():
        out[o] = f
    return out


def propagate(near: dict[str, dict[str, float]], rounds: int = 50, seed: int = 42) -> tuple[dict[str, str], int]:
    """Weighted label propagation: a round visits nodes by degree and then hash, each of which sees the labels that those before it have taken.

    Nodes are visited in waves of nodes that are no neighbours, so a round is some array operations and equals a visit one by one.
    """
    graph = Graph(near)
    label = np.arange(len(graph.names))
    for done in range(1, max(rounds, 1) + 1):
        hashes = np.array([_hash(seed, done, x) for x in graph.names])
        before = label.copy()
        for wave in graph.waves(np.lexsort((hashes, -graph.degree))):
            label[wave] = _choose(graph, wave, label, seed, done, stay=True, name=graph.names.__getitem__)
        if (label == before).all():
            break
    return {x: graph.names[c] for x, c in zip(graph.names, label.tolist(), strict=True)}, done


#: Steps whose hashes give the order of small members and their choice (fixed values).
ORDER_STEP, CHOICE_STEP = 9999, 10000


def merge_small(near: dict[str, dict[str, float]], label: dict[str, str], least: int, seed: int = 42) -> dict[str, str]:
    """Members of communities below `least` move, in hash order, to the heaviest neighbouring community of at least that size.

    Only members of small communities move, and only to large ones, so which communities are large never changes; a member sees where those
    before it have gone.
    """
    graph = Graph({x: near.get(x, {}) for x in label})
    # a community is numbered by a member's place, so that its number indexes nodes
    member = {label[x]: k for k, x in enumerate(graph.names)}
    name = {k: c for c, k in member.items()}
    now = np.array([member[label[x]] for x in graph.names])
    large = np.bincount(now, minlength=len(now)) >= least
    moves = np.flatnonzero(~large[now])
    hashes = np.array([_hash(seed, ORDER_STEP, graph.names[k]) for k in moves])
    for wave in graph.waves(moves[np.argsort(hashes, kind="stable")]):
        now[wave] = _choose(graph, wave, now, seed, CHOICE_STEP, stay=False, name=name.get, allowed=large)
    return {x: name[c] for x, c in zip(graph.names, now.tolist(), strict=True)}


def detect(edges: DataFrame, nodes: DataFrame, algorithm: str = "structural_entropy", rounds: int = 50, least: int = 1, seed: int = 42, key: str = "id") -> DataFrame:
    """(node, community): communities named by their smallest member; nodes without edges are their own. Node ids are compared as strings."""
    if algorithm not in ("structural_entropy", "label_propagation", "mutual_best"):
        raise ValueError(f"unknown algorithm {algorithm}")
    text = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
    alone = nodes.select(F.col(key).cast("string").alias("node"))
    if algorithm == "mutual_best":
        labels = mutual_best(text)
    else:
        total = 2 * (text.where("a <> b").agg(F.sum("weight").alias("w")).first().w or 0.0)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            near = _neighbours(pdf)
            label = agglomerate(near, total)[0] if algorithm == "structural_entropy" else propagate(near, rounds, seed)[0]
            if least > 1:
                label = merge_small(near, label, least, seed)
            first: dict[str, str] = {}
            for x in sorted(label):
                first.setdefault(label[x], x)
            return pd.DataFrame([(x, first[c]) for x, c in label.items()], columns=["node", "community"])

        labels = by_component(text.where("a <> b")).groupBy("component").applyInPandas(run, "node string, community string")
    return alone.join(labels, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def encoding_tree(edges: DataFrame) -> DataFrame:
    """The agglomeration's tree per component: (component, node_id, type, node, children, size, merge_gain, objective_after). The objective is the component's own."""
    text = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("weight")).where("weight > 0 and a <> b")
    total = 2 * (text.agg(F.sum("weight").alias("w")).first().w or 0.0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = agglomerate(_neighbours(pdf), total)[1]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["component", "node_id", "type", "node", "children", "size", "merge_gain", "objective_after"])

    schema = "component string, node_id string, type string, node string, children array<string>, size int, merge_gain double, objective_after double"
    return by_component(text).groupBy("component").applyInPandas(run, schema)


def flat_tree(labels: DataFrame) -> DataFrame:
    """A two-level tree: a node for each community over its members."""
    return labels.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("children"), F.count(F.lit(1)).alias("size"))


def tree_depths(tree: DataFrame) -> DataFrame:
    """(component, node, depth) of the leaves; roots have depth 1. One join a level, over a frontier that ends at the leaves."""
    links = tree.where("type <> 'leaf'").select("component", F.col("node_id").alias("parent"), F.explode("children").alias("node_id"))
    ids = tree.select("component", "node_id")
    front = ids.join(links.select("component", "node_id"), ["component", "node_id"], "left_anti").withColumn("depth", F.lit(1))
    out, front = None, written(front, "tree")
    while not front.isEmpty():
        leaf = front.join(tree.where("type = 'leaf'").select("component", "node_id", "node"), ["component", "node_id"]).select("component", "node", "depth")
        out = leaf if out is None else out.unionByName(leaf)
        below = front.withColumnRenamed("node_id", "parent").join(links, ["component", "parent"]).select("component", "node_id", (F.col("depth") + 1).alias("depth"))
        front = written(below, "tree")
    return out


def community_depths(depths: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: its members' mean leaf depth."""
    return labels.join(depths.select("node", "depth"), "node", "left").groupBy("community").agg(F.coalesce(F.avg("depth"), F.lit(0.0)).alias("encoding_depth"))


def tree_depth(depths: DataFrame) -> DataFrame:
    """One row: the depth of the deepest leaf."""
    return depths.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def exact_subtrees(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, exact): whether some tree node has exactly a community's members. Sizes and members' parents are compared level by level.

    A node that holds all members of a community and no others is the lowest one whose leaves are that many: leaves hand their community up
    for as long as a node's children all have the same one.
    """
    links = tree.where("type <> 'leaf'").select("component", F.col("node_id").alias("parent"), "size", F.explode("children").alias("node_id"), F.size("children").alias("n_children"))
    pure = tree.where("type = 'leaf'").join(labels, "node").select("component", "node_id", "community", F.lit(1).cast("int").alias("size"))
    every, front = None, written(pure, "pure")
    while not front.isEmpty():
        every = front if every is None else written(every.unionByName(front).distinct(), "pure")
        up = every.withColumnRenamed("size", "_s").join(links, ["component", "node_id"])
        up = up.groupBy("component", "parent", "size", "n_children").agg(F.count(F.lit(1)).alias("_n"), F.min("community").alias("community"), F.max("community").alias("_c")).where("_n = n_children and community = _c")
        front = written(up.selectExpr("component", "parent as node_id", "community", "size").join(every.select("component", "node_id"), ["component", "node_id"], "left_anti"), "pure")
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("_all"))
    top = every.groupBy("community").agg(F.max("size").alias("_top")) if every is not None else sizes.select("community", F.lit(0).alias("_top"))
    return sizes.join(top, "community", "left").select("community", F.coalesce(F.col("_top") == F.col("_all"), F.lit(False)).alias("exact"))


def match_trees(labels: DataFrame, tree: DataFrame) -> DataFrame:
    """Communities with the flat tree node that has exactly their members."""
    mine = labels.groupBy("community").agg(F.sha1(F.array_join(F.array_sort(F.collect_set("node")), "\n")).alias("signature"))
    theirs = tree.select(F.col("community").alias("tree_node"), F.sha1(F.array_join(F.array_sort(F.array_distinct("children")), "\n")).alias("signature"))
    return mine.join(theirs, "signature", "left").select("community", "tree_node")


def community_ids(labels: DataFrame) -> DataFrame:
    """(node, community, community_id, size): ids c0001, c0002, ... by size and then smallest member. The numbering is over communities, not nodes."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("_first"))
    numbered = sizes.withColumn("community_id", F.format_string("c%04d", F.row_number().over(Window.orderBy(F.col("size").desc(), "_first")))).drop("_first")
    return labels.join(numbered, "community")


def mutual_best(edges: DataFrame) -> DataFrame:
    """Approximate agglomeration in rounds: each community picks its best positive gain (ties by id), and pairs that pick each other merge. (node, community).

    Rounds end when no merger has a positive gain. The best pair of all always merges, as a pair's gain is computed once for both of its ends. A
    hub merges with one neighbour a round, so rounds may be as many as a hub has neighbours. A round is some joins while there are more than
    LARGEST links; what is left then is finished by the same rounds over arrays in one task.
    """
    total = 2 * (edges.where("a <> b").agg(F.sum("weight").alias("w")).first().w or 0.0)
    both = adjacency(edges.where("a <> b"))
    labels = written(both.select("node").distinct().withColumn("community", F.col("node")), "mutual")
    stats = written(both.groupBy(F.col("node").alias("c")).agg(F.sum("weight").alias("v")).withColumn("i", F.lit(0.0)), "mutual")
    links = written(both.groupBy(F.col("node").alias("x"), F.col("other").alias("y")).agg(F.sum("weight").alias("w")), "mutual")
    term = lambda v, i: entropy_term(v, i, F.lit(total))
    while links.count() > 2 * LARGEST:
        pair = links.where("x < y").join(stats.selectExpr("c as x", "v as vx", "i as ix"), "x").join(stats.selectExpr("c as y", "v as vy", "i as iy"), "y")
        gain = term(F.col("vx"), F.col("ix")) + term(F.col("vy"), F.col("iy")) - term(F.col("vx") + F.col("vy"), F.col("ix") + F.col("iy") + F.col("w"))
        pair = pair.select("x", "y", F.round(gain, 12).alias("g")).where(F.col("g") > EPS)
        best = pair.unionByName(pair.selectExpr("y as x", "x as y", "g")).groupBy("x").agg(F.max_by("y", F.struct("g", F.struct(F.least("x", "y"), F.greatest("x", "y")))).alias("y"))
        merge = written(best.join(best.selectExpr("x as y", "y as x"), ["x", "y"], "left_semi").where("x > y").selectExpr("x as old", "y as new"), "mutual")
        if merge.isEmpty():
            return labels
        old = (merge, labels, stats, links)
        to = lambda df, c: df.join(merge.selectExpr(f"old as {c}", "new as _new"), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
        labels = written(to(labels, "community"), "mutual")
        moved = to(to(links, "x"), "y")
        # each inner link was there in both directions
        inside = moved.where("x = y").groupBy(F.col("x").alias("c")).agg((F.sum("w") / 2).alias("more"))
        stats = to(stats, "c").groupBy("c").agg(F.sum("v").alias("v"), F.sum("i").alias("i")).join(inside, "c", "left")
        stats = written(stats.select("c", "v", (F.col("i") + F.coalesce("more", F.lit(0.0))).alias("i")), "mutual")
        links = written(moved.where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")), "mutual")
        for df in old:
            drop_written(df)
    ids = written(numbered(stats.select("c"), "c"), "mutual")
    number = lambda c: ids.withColumnsRenamed({"c": c, "number": f"_{c}"})
    pairs = links.where("x < y").join(number("x"), "x").join(number("y"), "y").selectExpr("_x as x", "_y as y", "w", "0D as i")
    rows = pairs.unionByName(stats.join(number("c"), "c").selectExpr("_c as x", "-1 as y", "v as w", "i"))
    found = rows.repartition(1).mapInArrow(lambda batches: _mutual_rounds(batches, total), "number int, _to int")
    ends = found.join(ids.withColumnRenamed("c", "community"), "number").join(ids.selectExpr("number as _to", "c as _new"), "_to").select("community", "_new")
    return labels.join(ends, "community").selectExpr("node", "_new as community")


def _mutual_rounds(batches: Iterator[pa.RecordBatch], total: float) -> Iterator[pa.RecordBatch]:
    """(number, _to): the last community of each, by the rounds of mutual_best. Rows are links (x < y, w) and, with y = -1, communities with volume w and internal weight i.

    A link's gain changes only when one of its ends has merged, so others keep theirs, and only links of positive gain are sorted.
    """
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    x, y, w, i = (np.concatenate([b[c].to_numpy() for b in read]) for c in ("x", "y", "w", "i"))
    alone = y < 0
    n = int(alone.sum())
    volume, inner = np.zeros(n), np.zeros(n)
    volume[x[alone]], inner[x[alone]] = w[alone], i[alone]
    x, y, w = x[~alone].astype(np.int64), y[~alone].astype(np.int64), w[~alone]

    def term(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        at = np.where(v > 0, v, 1.0)
        return np.where(v > 0, -(np.maximum(v - 2 * k, 0.0) / total) * np.log2(at / total) + (at / total) * np.log2(at), 0.0)

    def gains(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.round(term(volume[x], inner[x]) + term(volume[y], inner[y]) - term(volume[x] + volume[y], inner[x] + inner[y] + w), 12)

    label, gain = np.arange(n), gains(x, y, w)
    while True:
        live = np.flatnonzero(gain > EPS)
        live = live[np.lexsort((y[live], x[live], gain[live]))]
        best = np.full(n, -1)
        place = np.arange(len(live))
        best[x[live]] = place  # of several the last, which is the best
        other = np.full(n, -1)
        other[y[live]] = place
        best = np.maximum(best, other)
        chosen = live[(best[x[live]] == place) & (best[y[live]] == place)]
        if not len(chosen):
            break
        new, old = x[chosen], y[chosen]
        volume[new] += volume[old]
        inner[new] += inner[old] + w[chosen]
        to = np.arange(n)
        to[old] = new
        label = to[label]
        merged = np.zeros(n, bool)
        merged[new] = merged[old] = True
        near = merged[x] | merged[y]
        a, b = to[x[near]], to[y[near]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        key, back = np.unique(lo[apart] * n + hi[apart], return_inverse=True)
        joined = np.bincount(back, w[near][apart], minlength=len(key))
        a, b = key // n, key % n
        x, y, w, gain = (np.concatenate(z) for z in ((x[~near], a), (y[~near], b), (w[~near], joined), (gain[~near], gains(a, b, joined))))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(label.astype(np.int32))], ["number", "_to"])
