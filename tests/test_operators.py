"""Operators on small hand-made fixtures, and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from murmur.operators import community, enrich, evaluate, experiments, features, graph, sampling
from murmur.operators.components import components


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "a string, b string, weight double")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


TWO = [("u1", "u2", 0.95), ("u3", "u4", 0.94), ("u2", "u3", 0.02)]


def test_largest_remainder(spark):
    g = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    assert {r.k: r.quota for r in sampling.largest_remainder(g, "k", "w", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    zero = sampling.largest_remainder(g.withColumn("w", F.lit(0)), "k", "w", 4).collect()
    assert all(r.quota == 0 for r in zero)
    assert all(r.quota == 0 for r in sampling.largest_remainder(g, "k", "w", -1).collect())


def test_seeds_are_reproducible_and_fill_quotas(spark):
    rows = [(f"u{i}", "train" if i < 4 else "test", "bot" if i % 2 else "human", "false", i, i, 10, i % 3 != 0, i % 3 == 0) for i in range(8)]
    rows += [("x", "missing", "bot", "false", 1, 1, 1, True, False)]
    p = spark.createDataFrame(rows, "user_id string, split string, label string, verified_bucket string, followers_count long, following_count long, tweet_count_hint long, primary_pool boolean, sparse_pool boolean")
    got = sampling.select_seeds(p, 4, 7).collect()
    assert sorted(r.user_id for r in got) == sorted(r.user_id for r in sampling.select_seeds(p.repartition(3), 4, 7).collect())
    assert sorted(r.split for r in got) == ["test", "test", "train", "train"]
    assert sampling.downsample_users(p, 4).count() == 4


def test_context_drops_hubs_of_one_seed(spark):
    e = spark.createDataFrame([("s1", "c1"), ("c1", "s1"), ("c2", "s1"), ("s1", "c3"), ("hub", "s1")], "source string, target string")
    degrees = spark.createDataFrame([("c1", 10), ("c2", 11), ("c3", 12), ("hub", 1000)], "user_id string, degree int")
    got = {r.candidate_id: r.category for r in sampling.context_topk(e, spark.createDataFrame([("s1",)], "user_id string"), degrees).collect()}
    assert got == {"c1": "mutual", "c2": "follower", "c3": "following"}


def test_even_spacing_and_closure(spark):
    tweets = spark.createDataFrame([("u1", "t1", 1, ["t99"]), ("u1", "t2", 2, []), ("u1", "t3", 3, [])], "user_id string, tweet_id string, ts int, references array<string>")
    kept = sampling.finalize_tweets(tweets, 2)
    assert sorted(r.tweet_id for r in kept.collect()) == ["t1", "t3"]
    every = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t99",)], "tweet_id string")
    assert {(r.tweet_id, r.added) for r in sampling.reference_closure(kept, every).collect()} == {("t1", False), ("t3", False), ("t99", True)}


def test_validation(spark):
    users = spark.createDataFrame([("u1", "train", "bot"), ("u2", "test", "human")], "user_id string, split string, label string")
    tweets = spark.createDataFrame([("t1",)], "tweet_id string")
    good = spark.createDataFrame([("u1", "t1", "post"), ("u1", "u2", "following")], "source_id string, target_id string, relation string")
    targets = {k: users.groupBy(k).agg(F.count("*").alias("n")) for k in ("split", "label")}
    assert sampling.validate(good, users, tweets, targets, 5).first().passed
    bad = good.union(spark.createDataFrame([("u1", "t9", "post")], good.schema))
    r = sampling.validate(bad, users, tweets, targets, 5).first()
    assert r.endpoint_errors == 1 and not r.passed


def test_task_selection(spark):
    tweets = spark.createDataFrame([("a", f"t{i}", i) for i in range(9)] + [("b", "x", 1)], "user_id string, tweet_id string, ts int")
    got = sampling.select_for_tasks(tweets, per_user=5, least=8).collect()
    assert len(got) == 5 and [r.ts for r in got] == sorted(r.ts for r in got)
    assert len(sampling.select_for_tasks(tweets, least=1, max_users=1, max_tweets=3).collect()) <= 3


def test_topk_over_blocks_equals_one_block(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(99, [0.0] * 5)], "id long, vector array<double>")
    key = lambda df: sorted((r.source, r.target, r["rank"], round(r.weight, 9)) for r in df.collect())
    assert key(graph.cosine_topk(rows, 4, block=7)) == key(graph.cosine_topk(rows, 4))
    assert graph.cosine_topk(rows, 4).where("source = 99 or target = 99").count() == 0


def test_early_fusion_fixture(spark):
    rows = spark.createDataFrame([("u1", [1.0, 0.0, 0.0]), ("u2", [0.9, 0.1, 0.0]), ("u3", [0.0, 1.0, 0.0]), ("u4", [-1.0, 0.0, 0.0])], "user_id string, fused array<double>")
    directed = graph.early_fusion(rows, 1, 0.05, 3)
    assert {(r.source, r.target) for r in directed.collect()} == {("u1", "u2"), ("u2", "u1"), ("u3", "u2")}
    assert {(r.a, r.b, r.support) for r in graph.symmetrize(directed).collect()} == {("u1", "u2", 2), ("u2", "u3", 1)}
    assert {(r.a, r.b) for r in graph.symmetrize(directed, "mutual_max").collect()} == {("u1", "u2")}
    assert graph.symmetrize(directed, "directed").count() == 3


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: find(x) for x in root if find(x) != x} == got


@pytest.mark.parametrize("algorithm", ["structural_entropy", "label_propagation", "mutual_best"])
def test_two_communities(spark, algorithm):
    got = {r.node: r.community for r in community.detect(edges_of(spark, TWO), nodes_of(spark, ["u1", "u2", "u3", "u4", "alone"]), algorithm).collect()}
    assert got == {"u1": "u1", "u2": "u1", "u3": "u3", "u4": "u3", "alone": "alone"}


def random_graph(seed, n=24, m=40):
    rng = random.Random(seed)
    near = {}
    for _ in range(m):
        a, b = (f"n{x:02d}" for x in rng.sample(range(n), 2))
        w = round(rng.random() + 0.01, 3)
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    return near


def entropy(near, label):
    total = sum(sum(n.values()) for n in near.values())
    out = 0.0
    for c in set(label.values()):
        members = {x for x in near if label[x] == c}
        v = sum(sum(near[x].values()) for x in members)
        inner = sum(w for x in members for y, w in near[x].items() if y in members)
        out += -((v - inner) / total) * math.log2(v / total) + v / total * math.log2(v)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_agglomeration_lowers_entropy_and_equals_its_tree(seed):
    near = random_graph(seed)
    total = sum(sum(n.values()) for n in near.values())
    assert entropy(near, {x: x for x in near}) == pytest.approx(math.log2(total))
    label, tree = community.agglomerate(near, total)
    assert entropy(near, label) <= math.log2(total) + 1e-9
    merges = [r for r in tree if r[1] == "merge"]
    if merges:
        assert merges[-1][-1] == pytest.approx(entropy(near, label))
        assert all(r[-2] > 0 for r in merges)
    assert len({x for r in tree if r[1] == "leaf" for x in [r[2]]}) == len(near)


@pytest.mark.parametrize("seed", range(4))
def test_propagation_by_component_equals_whole_graph(spark, seed):
    near = random_graph(seed, 30, 30)
    label, _ = community.propagate(near)
    whole = community.merge_small(near, label, 3)
    rows = [(a, b, w) for a, n in near.items() for b, w in n.items() if a < b]
    got = {r.node: r.community for r in community.detect(edges_of(spark, rows), nodes_of(spark, sorted(near)), "label_propagation", least=3).collect()}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == c) for c in set(m.values()))
    assert groups(got) == groups(whole)


def test_trees(spark):
    tree = community.encoding_tree(edges_of(spark, TWO))
    depths = {r.node: r.depth for r in community.tree_depths(tree).collect()}
    assert depths == {"u1": 2, "u2": 2, "u3": 2, "u4": 2}
    labels = spark.createDataFrame([("u1", "x"), ("u2", "x"), ("u3", "y"), ("u4", "y")], "node string, community string")
    assert {r.community: r.encoding_depth for r in community.community_depths(community.tree_depths(tree), labels).collect()} == {"x": 2.0, "y": 2.0}
    assert community.tree_depth(community.tree_depths(tree)).first().depth == 2
    assert {r.community: r.exact for r in community.exact_subtrees(tree, labels).collect()} == {"x": True, "y": True}
    mixed = spark.createDataFrame([("u1", "x"), ("u2", "y"), ("u3", "y"), ("u4", "y")], "node string, community string")
    assert {r.community: r.exact for r in community.exact_subtrees(tree, mixed).collect()} == {"x": True, "y": False}
    assert {r.community: r.tree_node for r in community.match_trees(labels, community.flat_tree(labels)).collect()} == {"x": "x", "y": "y"}
    ids = {r.node: r.community_id for r in community.community_ids(labels).collect()}
    assert ids == {"u1": "c0001", "u2": "c0001", "u3": "c0002", "u4": "c0002"}


def test_structure_fixture(spark):
    e = edges_of(spark, [("u1", "u2", 0.8), ("u2", "u3", 0.8), ("u1", "u3", 0.8), ("u4", "u5", 0.7)])
    labels = spark.createDataFrame([(f"u{i}", "a" if i < 4 else "b") for i in range(1, 6)], "node string, community string")
    got = {r.community: r for r in community.structure(e, labels).collect()}
    assert (got["a"].density, got["a"].clustering, got["b"].density, got["b"].clustering) == (1.0, 1.0, 1.0, 0.0)
    q = community.partition_quality(e, labels).first()
    assert q.communities == 2 and q.conductance == 0 and q.modularity == pytest.approx(1 - (4.8 / 6.2) ** 2 - (1.4 / 6.2) ** 2)


def members(spark):
    rows = [("a1", "A", "train", "bot"), ("a2", "A", "train", "bot"), ("a3", "A", "test", "bot"), ("b1", "B", "train", "human"), ("b2", "B", "train", "human"), ("b3", "B", "test", "human"), ("c1", "C", "test", "missing")]
    return spark.createDataFrame(rows, "user_id string, community_id string, split string, label string")


def test_evaluation(spark):
    out = evaluate.evaluate_partition(members(spark))
    p = {r.community_id: r for r in out["profiles"].collect()}
    assert p["A"].bot_score == pytest.approx((2 + 0.5) / 3) and p["C"].bot_score == 0.5 and p["C"].label_source == "global_train_prior"
    assert p["C"].purity == 0 and out["purity"].first().global_purity == pytest.approx(6 / 7)
    m = {r.split: r for r in out["metrics"].collect()}
    assert m["test"].accuracy == m["test"].auc == m["all"].f1 == 1.0


def test_auc(spark):
    rows = spark.createDataFrame([("bot", 0.9), ("bot", 0.5), ("human", 0.5), ("human", 0.1)], "label string, bot_score double")
    assert evaluate.auc(rows).first().auc == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert evaluate.auc(rows.where("label = 'bot'")).first().auc == 0.0


@pytest.mark.parametrize(("values", "want"), [((75, 0.15, 0.85, 0, 0), 0), ((80, 0.55, 0.7, 0, 0), 1), ((20, 0.3, 0.5, 0.24, 9), 2), ((20, 0.3, 0.5, 0.25, 3.4), 2), ((21, 0.3, 0.5, 0.1, 1), 3), ((74, 0.1, 0.9, 0.9, 9), 3)])
def test_archetype_boundaries(spark, values, want):
    got = spark.range(1).select(evaluate.archetype(*[F.lit(float(v)) for v in values]).alias("x")).first().x
    assert got == evaluate.ARCHETYPES[want]


def test_reranker_beats_the_prior(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        y = rng.random() < 0.5
        rows.append((f"u{i}", ("train", "train", "valid", "test")[i % 4], "bot" if y else "human", "c", rng.gauss(2.0 if y else 0.0, 1), 1.0))
    t = spark.createDataFrame(rows, "user_id string, split string, label string, community_id string, x double, flat double")
    out = experiments.rerank(t, ["x", "flat"], epochs=20, rate=0.5)
    assert out["weights"]["x"] > 0 and out["weights"]["flat"] == 0
    assert evaluate.binary_metrics(out["predictions"]).where("split = 'test'").first().f1 > 0.7


def test_changes(spark):
    before = spark.createDataFrame([("a", "test", "bot", "c", "human"), ("b", "test", "bot", "c", "bot"), ("d", "test", "human", "c", "bot")], "user_id string, split string, label string, community_id string, predicted_label string")
    after = spark.createDataFrame([("a", "bot"), ("b", "human"), ("d", "bot")], "user_id string, predicted_label string")
    r = experiments.change_summary(experiments.changed_predictions(before, after)).first()
    assert (r.fixed, r.regressed, r.unchanged_wrong, r.net_gain) == (1, 1, 1, 0)


def test_baselines_and_sweep(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", ("train", "train", "valid", "test")[i % 4], "bot" if i % 2 else "human", rng.gauss(3.0 * (i % 2), 1), rng.random()) for i in range(120)]
    t = spark.createDataFrame(rows, "user_id string, split string, label string, x double, y2 double")
    data = experiments.matrix(t, experiments.numeric_columns(t))
    name, _, metrics = experiments.logistic_grid(data, (1.0,), (False, True))
    assert name.startswith("lr_") and metrics.where("split = 'test'").first().f1 > 0.8
    assert experiments.forest_grid(data, (5,), (4,))[2].where("split = 'test'").first().f1 > 0.7
    k, groups = experiments.kmeans_baseline(data, (2, 4), starts=2)
    assert k in (2, 4) and groups.count() == 120
    assert experiments.baseline_summary({"lr": metrics}).first().method == "lr"


def test_walks_stay_on_edges(spark):
    follows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "x")], "source string, target string")
    users = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user_id string")
    near = experiments.walk_graph(follows, users)
    links = {(r.node, n) for r in near.collect() for n in r.neighbours}
    assert links == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "c"), ("c", "a")}
    for p, q in ((1.0, 1.0), (0.25, 4.0)):
        for r in experiments.walks(near, 2, 6, p=p, q=q, stride=3).collect():
            assert len(r.walk) == 6 and all(x in links for x in zip(r.walk[:-1], r.walk[1:], strict=True))
    back = experiments.walks(near, 60, 3, p=1e-6, q=1.0).collect()
    assert sum(r.walk[0] == r.walk[2] for r in back) > 0.95 * len(back)


def test_features(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    tweets = spark.createDataFrame([("u1", "a"), ("u9", "")], "user_id string, text string")
    follows = spark.createDataFrame([("u1", "u2"), ("u1", "u2")], "source string, target string")
    a = {r.user_id: r for r in features.user_audit(users, tweets, follows, {"text": F.col("text") != "", "dated": F.lit(True)}, 1, 1).collect()}
    assert a["u1"].out_degree == 2 and a["u9"].tweets == 1 and not a["u9"].in_users and a["u2"].tweets == 0 and a["u2"].can_network == 1
    net = {r.user_id: r for r in features.network_vectors(follows, users).collect()}
    assert net["u1"].followed == ["u2"] and net["u1"].out_degree == 2
    z = features.zscores(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"], flat="zero").collect()
    assert [r.z for r in z] == [[-1.0, 0.0], [1.0, 0.0]]
    docs = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "user_id string, o int, t string")
    assert features.user_documents(docs, "o", "t").first().document == "a\nb"
    emb = spark.createDataFrame([("u1", [1.0])], "user_id string, embedding array<double>")
    num = spark.createDataFrame([("u1", [2.0]), ("u2", [3.0])], "user_id string, z array<double>")
    assert {r.user_id: r.fused for r in features.fused_vectors(emb, num, 2).collect()} == {"u1": [1.0, 0.0, 2.0], "u2": [0.0, 0.0, 3.0]}


class Stub:
    def complete(self, system, user):
        if "broken" in user:
            raise ValueError("no")
        return 'Sure: ```json\n{"coarse_type": "original", "detail_type": "odd", "confidence": "0.5", "triplets": [["a", "b", "c"], {"s": "x", "relation": "y", "tail": "z"}, ["a"]]}\n```'

    def embed(self, texts):
        return [[float(len(t))] for t in texts]


def test_enrichment(spark):
    kinds = "tweet_id string, user_id string, text string, references array<struct<id:string,type:string>>, urls array<struct<expanded_url:string,display_url:string,url:string>>"
    tweets = spark.createDataFrame([("1", "u", "RT @x: y", [], []), ("2", "u", "plain", [], []), ("3", "u", "broken", [], [])], kinds)
    assert {r.tweet_id: r.coarse for r in enrich.classify_post_types(tweets, mode="heuristic").collect()} == {"1": "retweet", "2": "original", "3": "original"}
    asked = tweets.where("tweet_id <> '3'")
    got = {r.tweet_id: r for r in enrich.classify_post_types(asked, Stub).collect()}
    assert got["1"].source == "rule" and got["2"].coarse == "original" and got["2"].detail == "original" and got["2"].confidence == 0.5
    t = enrich.extract_triplets(asked.select("tweet_id", "user_id", F.lit(1).alias("ord"), "text"), Stub).where("tweet_id = '2'").first()
    assert t.triplet_text == "a | b | c\nx | y | z" and t.error is None
    assert enrich.embed(asked, Stub).where("tweet_id = '2'").first().embedding == [5.0]


def test_service_answers():
    assert enrich.message_content({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    assert enrich.embedding_vectors({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1.0], [2.0]]
    for f in (lambda: enrich.message_content({}), lambda: enrich.embedding_vectors({"data": []}, 1)):
        with pytest.raises(ValueError):
            f()
    assert enrich.read_settings("# c\nexport A='x'\nB=y\n", {"B": "z"}, ("A", "B", "C")) == {"A": "x", "B": "z"}


def test_limiter_and_retries():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = enrich.RateLimiter(2, 60, lambda: now[0], sleep)
    for _ in range(3):
        limiter.wait()
    assert waits == [60]
    pauses = []
    assert enrich.call_with_retries(lambda: 1 / 0, 3, 2, pauses.append)[1].startswith("ZeroDivisionError") and pauses == [2, 4]
    for text, want in (('x {"a": 1} y', {"a": 1}), ('```json\n{"a": {"b": 2}}\n```', {"a": {"b": 2}}), ("{bad} {\"c\": 3}", {"c": 3}), ("none", None), ("[1]", None)):
        assert enrich.extract_json(text) == want
