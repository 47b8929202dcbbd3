"""Commands over a corpus folder: python -m murmur.cli COMMAND --sample-root DIR [options].

Each stage reads the folder and earlier stages' Parquet tables under analysis/, and writes its own there.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.functions import vectors as V
from murmur.operators import community, enrich, evaluate, experiments, features, graph, sampling
from murmur.sources import scans, sinks
from murmur.sources.corpus import Corpus
from murmur.sources.shared import written

COMMANDS: dict[str, tuple[Callable[[Corpus, argparse.Namespace], Any], dict[str, Any]]] = {}
RUN_TABLES = ("assignments", "profiles", "predictions", "metrics")
NUMERIC = [
    "followers_count", "following_count", "tweet_count_hint", "tweets", "tweets_text", "tweets_dated", "tweets_metrics", "tweets_references", "tweets_external", "out_degree", "in_degree", "can_text", "can_time",
    "can_behaviour", "can_network", *[f"ratio_{k}" for k in N.POST_TYPES],
]


def command(name: str, **options: Any) -> Callable:
    def add(f: Callable[[Corpus, argparse.Namespace], Any]) -> Callable:
        COMMANDS[name] = (f, options)
        return f

    return add


def _client(a: argparse.Namespace) -> Callable[[], Any] | None:
    """A factory given as module:name; its settings are its own."""
    if not a.client:
        return None
    module, _, name = a.client.partition(":")
    return getattr(importlib.import_module(module), name)


def _counts(df: DataFrame, *keys: str) -> dict[str, int]:
    return {"|".join(map(str, r[:-1])): r[-1] for r in df.groupBy(*keys).count().collect()}


@command("profile")
def profile(c: Corpus, a: argparse.Namespace) -> dict:
    return {"users": c.put(c.users(), "profile").count()}


@command("sample", preset="smoke", size=0, seed=42, out="")
def sample(c: Corpus, a: argparse.Namespace) -> dict:
    """Seeds, context, tweets, references and closed edges, as a new folder that must not exist."""
    if not c.has("profile"):
        profile(c, a)
    users, follows = c.get("profile"), written(c.follows(), "follows")
    seeds = written(sampling.select_seeds(users, a.size or a.preset, a.seed), "seeds")
    near = sampling.context_topk(follows, seeds, users.select("user_id", F.col("degree_proxy").alias("degree")), a.seed)
    kept = seeds.select("user_id", F.lit(sampling.SEED_TWEETS).alias("quota"))
    context = near.select(F.col("candidate_id").alias("user_id")).distinct().join(seeds.select("user_id"), "user_id", "left_anti").join(users.select("user_id"), "user_id", "left_semi")
    kept = written(kept.unionByName(context.withColumn("quota", F.lit(sampling.CONTEXT_TWEETS))), "kept")
    tweets, edges = written(c.tweets(), "tweets"), written(c.tweet_edges().drop("place"), "edges")
    posts = edges.where("relation = 'post'").select(F.col("source_id").alias("user_id"), F.col("target_id").alias("tweet_id")).distinct()
    final = None
    for quota in (sampling.SEED_TWEETS, sampling.CONTEXT_TWEETS):
        own = posts.join(kept.where(F.col("quota") == quota), "user_id", "left_semi")
        own = sampling.top_by_hash(own, "user_id", "tweet_id", quota * sampling.PREFILTER, a.seed, "post").drop("place").join(tweets.select("tweet_id", "ts", "references"), "tweet_id")
        part = sampling.finalize_tweets(own, quota, a.seed)
        final = part if final is None else final.unionByName(part)
    final = written(final.withColumn("references", N.referenced_ids("references")), "final")
    ids = written(sampling.reference_closure(final, tweets).select("tweet_id"), "ids")
    every = edges.unionByName(follows.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("following").alias("relation")))
    chosen = users.join(kept, "user_id", "left_semi").withColumn("id", F.col("user_id"))
    body = tweets.join(ids, "tweet_id", "left_semi")
    closed = sampling.close_edges(every, kept, ids)
    tweets_out = body.select(
        F.col("tweet_id").alias("id"), F.col("user_id").alias("author_id"), "text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "lang", "source", "in_reply_to_user_id",
        F.col("references").alias("referenced_tweets"), F.struct(F.col("urls").alias("urls")).alias("entities"),
    )
    sinks.export_sample({"user": chosen, "tweet": tweets_out, "edge": closed}, a.out, {"seed": a.seed, "seeds": seeds.count(), "users": kept.count(), "tweets": ids.count()})
    return {"users": kept.count(), "tweets": ids.count()}


@command("validate", budget=40_000, target_root="")
def validate(c: Corpus, a: argparse.Namespace) -> dict:
    users = c.users()
    goal = Corpus(c.spark, a.target_root).users() if a.target_root else users
    targets = {k: goal.where(F.col(k) != "missing").groupBy(k).agg(F.count(F.lit(1)).alias("n")) for k in ("split", "label")}
    return sampling.validate(c.edges(), users, c.tweets(), targets, a.budget).first().asDict()


@command("audit", min_triplet=8, min_time=8, min_behaviour=1)
def audit(c: Corpus, a: argparse.Namespace) -> dict:
    flags = {
        "text": F.trim(F.coalesce("text", F.lit(""))) != "", "dated": F.col("ts").isNotNull(), "metrics": F.col("has_metrics"), "references": F.size("references") > 0,
        "external": N.has_external_url("urls"), "lang": F.col("lang").isNotNull(), "source": F.col("source").isNotNull(),
    }
    out = c.put(features.user_audit(c.users().select("user_id"), c.tweets(), c.follows(), flags, a.min_triplet, a.min_time, a.min_behaviour), "audit")
    return {"summary": features.audit_summary(out).first().asDict(), "languages": _counts(features.top_values(c.tweets(), "lang"), "lang")}


def _selected(c: Corpus, a: argparse.Namespace, least: int) -> DataFrame:
    return sampling.select_for_tasks(c.tweets().where("trim(coalesce(text, '')) <> ''"), a.per_user, least, a.max_users or None, a.max_tweets or None, a.seed)


def _asked(c: Corpus, name: str, rows: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """All answers so far, and the errors of this run. Records that an earlier run answered are not asked again; those that failed are.

    Answers are appended to NAME.jsonl and failures with their error to NAME_errors.jsonl; the table between makes each call happen once.
    """
    good, bad = (f"{c.root}/analysis/{name}{end}.jsonl" for end in ("", "_errors"))
    if c.has(f"{name}.jsonl"):
        rows = scans.unprocessed(rows, c.spark.read.schema("tweet_id string").json(good), "tweet_id")
    found = written(ask(rows), name)
    sinks.write_split(found, good, bad)
    return c.spark.read.schema(found.drop("error").schema).json(good), found.where("error is not null").count()


@command("classify-post-types", mode="hybrid", per_user=20, least=1, max_users=0, max_tweets=0, seed=42, client="")
def classify_post_types(c: Corpus, a: argparse.Namespace) -> dict:
    good, errors = _asked(c, "post_types", _selected(c, a, a.least), lambda rows: enrich.classify_post_types(rows, _client(a), a.mode))
    c.put(features.type_distribution(good.withColumnRenamed("coarse", "kind"), N.POST_TYPES), "post_type_distribution")
    return {"tweets": good.count() + errors, "errors": errors}


@command("extract-triplets", per_user=20, least=8, max_users=0, max_tweets=0, seed=42, client="")
def extract_triplets(c: Corpus, a: argparse.Namespace) -> dict:
    rows = _selected(c, a, a.least).select("tweet_id", "user_id", F.coalesce(F.unix_seconds("ts"), F.lit(1 << 60)).alias("ord"), "text")
    good, errors = _asked(c, "triplets", rows, lambda r: enrich.extract_triplets(r, _client(a)))
    c.put(features.triplet_documents(good), "triplet_documents")
    return {"tweets": good.count() + errors, "errors": errors}


@command("downsample-final", target_users=1000, seed=42, out="")
def downsample_final(c: Corpus, a: argparse.Namespace) -> dict:
    t = sampling.downsample(c.users(), c.tweets(), c.edges(), a.target_users, a.seed)
    sinks.export_sample({"user": t["users"].withColumn("id", F.col("user_id")), "tweet": t["tweets"].withColumnsRenamed({"tweet_id": "id", "user_id": "author_id"}), "edge": t["edges"]}, a.out, {"seed": a.seed, "target_users": a.target_users})
    return {"users": t["users"].count()}


@command("build-user-features")
def build_user_features(c: Corpus, a: argparse.Namespace) -> dict:
    tables = [c.get("audit")]
    tables += [c.get(n) for n in ("post_type_distribution", "triplet_documents") if c.has(n)]
    out = features.feature_table(c.users(), *[t.drop("in_users") for t in tables])
    for name in NUMERIC:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0.0))
    if "triplet_document" not in out.columns:
        out = out.withColumn("triplet_document", F.lit(None).cast("string"))
    return {"users": c.put(out, "features").count()}


@command("build-user-vectors", client="", dims=64)
def build_user_vectors(c: Corpus, a: argparse.Namespace) -> dict:
    rows = c.get("features")
    numeric = features.zscores(rows, NUMERIC, flat="zero").select("user_id", "z")
    factory = _client(a)
    if factory:
        text = rows.withColumn("_t", N.choose_text("triplet_document", "description")).select("user_id", F.col("_t.text").alias("text"), F.col("_t.source").alias("text_source"))
        asked = c.put(enrich.embed(text.where("text_source <> 'missing'"), factory).select("user_id", "text_source", "embedding", "error"), "embedding_answers")
        c.put(asked.where("error is null").drop("error"), "embeddings")
        c.put(asked.where("error is not null").select("user_id", "error"), "embedding_errors")
    empty = c.spark.createDataFrame([], "user_id string, embedding array<double>")
    fused = features.fused_vectors(c.get("embeddings").select("user_id", "embedding") if factory else empty, numeric, a.dims)
    return {"users": c.put(fused, "fused").count()}


@command("build-temporal-profiles", least=8)
def build_temporal_profiles(c: Corpus, a: argparse.Namespace) -> dict:
    posts = c.tweet_edges().where("relation = 'post'").select(F.col("source_id").alias("user_id"), F.col("target_id").alias("tweet_id"), F.col("place").alias("ord"))
    return {"users": c.put(features.hour_histogram(features.tweet_authors(c.tweets(), posts), "ts", a.least), "temporal").count()}


def _bundles(c: Corpus) -> DataFrame:
    rows = c.get("features")
    out = rows.select("user_id")
    scalars = ["followers_count", "following_count", "tweets", "tweet_count_hint"]
    logged = rows.select("user_id", *[N.log1p_count(x).alias(x) for x in scalars], *[N.safe_ratio(f"tweets_{k}", "tweets").alias(k) for k in ("dated", "metrics", "references", "external")])
    behaviour = features.behaviour_vectors(logged, [x for x in logged.columns if x != "user_id"]).select("user_id", F.when(V.has_signal("z"), F.col("behaviour")).alias("behaviour"))
    mix = F.array(*[F.col(f"ratio_{k}").cast("double") for k in N.POST_TYPES])
    parts = [behaviour, rows.select("user_id", F.when(V.has_signal(mix), mix).alias("type_mix"))]
    parts.append(c.get("temporal").select("user_id", F.when(F.col("ready") == 1, F.col("distribution")).alias("hours")))
    net = features.network_vectors(c.follows(), out)
    parts.append(net.select("user_id", F.coalesce("followed", F.array().cast("array<string>")).alias("followed"), F.when(V.has_signal("degrees"), F.col("degrees_unit")).alias("degrees_unit")))
    parts.append(c.get("embeddings").select("user_id", "embedding") if c.has("embeddings") else c.spark.createDataFrame([], "user_id string, embedding array<double>"))
    for part in parts:
        out = out.join(part, "user_id", "left")
    return out


@command("build-user-graph", fusion="late", k=10, candidate_k=100, least=0.0, mode="union_max", dims=64)
def build_user_graph(c: Corpus, a: argparse.Namespace) -> dict:
    if a.fusion == "early":
        size = a.dims + len(NUMERIC)
        edges = graph.symmetrize(graph.early_fusion(c.get("fused"), a.k, a.least, size), a.mode)
    else:
        out = graph.late_fusion(written(_bundles(c), "bundles"), c.follows().distinct(), a.k, a.candidate_k, None, a.least, a.mode)
        c.put(out["scored"], "scored")
        c.put(out["directed"], "directed")
        edges = out["edges"]
    edges = c.put(edges, "graph")
    return graph.degree_summary(c.users(), edges, "user_id").first().asDict()


def _assign(c: Corpus, labels: DataFrame) -> DataFrame:
    ids = community.community_ids(labels).select(F.col("node").alias("user_id"), "community_id", F.col("size").alias("community_size"))
    return ids.join(c.users().select("user_id", "split", "label"), "user_id")


@command("detect-communities", algorithm="structural_entropy", iterations=50, min_size=1, bonus=0.1, seed=42)
def detect_communities(c: Corpus, a: argparse.Namespace) -> dict:
    edges = c.put(graph.mutual_bonus(c.get("graph"), a.bonus).select("a", "b", "weight"), "weighted_graph")
    labels = c.put(community.detect(edges, c.users(), a.algorithm, a.iterations, a.min_size, a.seed, "user_id"), "communities")
    c.put(_assign(c, labels), "assignments")
    tree = community.encoding_tree(edges) if a.algorithm == "structural_entropy" else community.flat_tree(labels)
    c.put(tree, "tree")
    return community.partition_entropy(edges, labels).first().asDict()


@command("evaluate-communities", threshold=0.5, alpha=1.0)
def evaluate_communities(c: Corpus, a: argparse.Namespace) -> dict:
    return _evaluate(c, a, "scores", False)


@command("evaluate-community-purity", threshold=0.5, alpha=1.0)
def evaluate_community_purity(c: Corpus, a: argparse.Namespace) -> dict:
    return _evaluate(c, a, "purity", True)


def _encoded(c: Corpus, profiles: DataFrame) -> DataFrame:
    """Profiles with the mean leaf depth of the members in the encoding tree, and whether one of its nodes has exactly these members."""
    tree, labels = c.get("tree"), c.get("assignments").selectExpr("user_id as node", "community_id as community")
    if "type" in tree.columns:
        found = community.community_depths(written(community.tree_depths(tree), "depths"), labels).join(community.exact_subtrees(tree, labels), "community")
    else:  # a flat tree: a node for each community
        found = community.match_trees(labels, tree).select("community", F.lit(1.0).alias("encoding_depth"), F.col("tree_node").isNotNull().alias("exact"))
    return profiles.join(found.withColumnsRenamed({"community": "community_id", "exact": "exact_subtree"}), "community_id", "left")


def _evaluate(c: Corpus, a: argparse.Namespace, name: str, by_majority: bool) -> dict:
    out = evaluate.evaluate_partition(c.get("assignments"), a.threshold, a.alpha, by_majority)
    if by_majority and c.has("tree"):
        out["profiles"] = _encoded(c, out["profiles"])
    for table in ("profiles", "predictions", "metrics"):
        c.put(out[table], f"{name}_{table}")
    return {"metrics": [r.asDict() for r in out["metrics"].collect()], **out["purity"].first().asDict()}


@command("analyze-community-structure")
def analyze_community_structure(c: Corpus, a: argparse.Namespace) -> dict:
    labels = c.get("assignments").selectExpr("user_id as node", "community_id as community")
    rows = community.structure(c.get("graph").select("a", "b", "weight"), labels).withColumnRenamed("community", "community_id").drop("size")
    rows = rows.join(c.get("purity_profiles"), "community_id")
    rows = c.put(rows.withColumn("archetype", evaluate.archetype(*[F.col(x) for x in ("community_size", "bot_ratio", "purity", "density", "average_degree")])), "structure")
    c.put(evaluate.representatives(rows), "representatives")
    return {"archetypes": _counts(rows, "archetype")}


@command("sweep-community-pipeline", ks="5,10,15", similarities="0,0.05", sizes="1,3,5", thresholds="0.2,0.3,0.4,0.5", algorithm="structural_entropy")
def sweep(c: Corpus, a: argparse.Namespace) -> dict:
    """Runs that an earlier sweep has are skipped."""
    old = [r.asDict() for r in c.get("sweep").collect()] if c.has("sweep") else []
    numbers = lambda text, kind: [kind(x) for x in text.split(",")]
    rows = c.users().select("user_id", "split", "label")

    def keep(row: dict, tables: dict[str, DataFrame]) -> None:
        for name in RUN_TABLES:
            c.put(tables[name], f"runs/{row['name']}/{name}")

    new = experiments.sweep(c.get("scored"), c.users().withColumnRenamed("user_id", "id"), rows, numbers(a.ks, int), numbers(a.similarities, float), numbers(a.sizes, int), numbers(a.thresholds, float), [a.algorithm], [r["name"] for r in old], keep=keep)
    every = experiments.rank_runs(old + new)
    c.put(written(c.spark.createDataFrame(every), "sweep"), "sweep")
    return {"runs": len(every), "best": every[0]["name"]}


@command("finalize-best-community-run", top=20)
def finalize(c: Corpus, a: argparse.Namespace) -> dict:
    """The best run's tables are copied to analysis/final."""
    out = experiments.finalize([r.asDict() for r in c.get("sweep").collect()], a.top)
    for name in RUN_TABLES if out["best"] else ():
        sinks.copy_table(c.spark, f"{c.root}/analysis/runs/{out['best']['name']}/{name}", f"{c.root}/analysis/final/{name}")
    extremes = experiments.extreme_communities(c.get("scores_profiles"))
    for side, df in extremes.items():
        c.put(df, f"top_{side}_communities")
    return out


@command("analyze-community-errors", split="test", top=100)
def analyze_errors(c: Corpus, a: argparse.Namespace) -> dict:
    table = c.get("features").select("user_id", *[F.col(x).cast("double").alias(x) for x in NUMERIC])
    out = experiments.error_analysis(c.get("scores_predictions"), table, NUMERIC, a.split, a.top)
    return {name: c.put(df, f"errors_{name}").count() for name, df in out.items()}


@command("train-community-reranker", rate=0.05, epochs=300, l2=0.001, patience=25, thresholds="0.1,0.2,0.3,0.4,0.5")
def train_reranker(c: Corpus, a: argparse.Namespace) -> dict:
    table = c.get("features").select("user_id", *[F.col(x).cast("double").alias(x) for x in NUMERIC])
    rows = c.get("scores_predictions").drop("predicted_label", "score_source").join(table, "user_id")
    rows = rows.withColumn("community_bot_score", F.col("bot_score")).withColumn("log_community_size", N.log1p_count("community_size")).drop("bot_score")
    out = experiments.rerank(rows, ["community_bot_score", "log_community_size", *NUMERIC], [float(x) for x in a.thresholds.split(",")], rate=a.rate, epochs=a.epochs, l2=a.l2, patience=a.patience)
    metrics = evaluate.binary_metrics(c.put(out["predictions"].select("user_id", "split", "label", "community_id", "bot_score", "predicted_label"), "reranker_predictions"))
    return {"threshold": out["threshold"], "epochs": out["epochs"], "weights": out["weights"], "metrics": [r.asDict() for r in metrics.collect()]}


@command("analyze-community-reranker", split="test")
def analyze_reranker(c: Corpus, a: argparse.Namespace) -> dict:
    changes = c.put(experiments.changed_predictions(c.get("scores_predictions"), c.get("reranker_predictions")).where(F.col("split") == a.split), "reranker_changes")
    c.put(experiments.change_summary(changes), "reranker_communities")
    return _counts(changes, "outcome")


def _matrix(c: Corpus) -> DataFrame:
    rows = c.get("features").select("user_id", "split", "label", *[F.col(x).cast("double").alias(x) for x in NUMERIC])
    return experiments.matrix(rows.where("label in ('bot', 'human') and split <> 'missing'"), NUMERIC)


def _keep(c: Corpus, name: str, chosen: tuple[str, DataFrame, DataFrame]) -> dict:
    c.put(chosen[1], f"baseline_{name}")
    c.put(chosen[2], f"baseline_{name}_metrics")
    return {"chosen": chosen[0]}


@command("run-feature-baselines", cs="0.1,1,10", trees="200,500", depths="8,16,0")
def feature_baselines(c: Corpus, a: argparse.Namespace) -> dict:
    data = written(_matrix(c), "matrix")
    depths = [int(x) or None for x in a.depths.split(",")]
    return {"logistic": _keep(c, "logistic", experiments.logistic_grid(data, [float(x) for x in a.cs.split(",")])), "forest": _keep(c, "forest", experiments.forest_grid(data, [int(x) for x in a.trees.split(",")], depths))}


@command("run-graph-baselines", dim=128, ps="0.5,1,2", qs="0.5,1,2")
def graph_baselines(c: Corpus, a: argparse.Namespace) -> dict:
    rows = c.users().where("label in ('bot', 'human') and split <> 'missing'").select("user_id", "split", "label")
    grid = [(float(p), float(q)) for p in a.ps.split(",") for q in a.qs.split(",")]
    return {"deepwalk": _keep(c, "deepwalk", experiments.walk_baseline(c.follows(), rows, dim=a.dim)), "node2vec": _keep(c, "node2vec", experiments.walk_baseline(c.follows(), rows, grid, dim=a.dim))}


@command("run-kmeans-baseline", ks="32,64,128,256,512,898", starts=10)
def kmeans_baseline(c: Corpus, a: argparse.Namespace) -> dict:
    k, rows = experiments.kmeans_baseline(_matrix(c), [int(x) for x in a.ks.split(",")], starts=a.starts)
    c.put(rows, "baseline_kmeans")
    c.put(evaluate.evaluate_partition(rows)["metrics"], "baseline_kmeans_metrics")
    return {"k": k}


@command("summarize-grouping-baselines")
def summarize_groupings(c: Corpus, a: argparse.Namespace) -> dict:
    """Quality of the k-means, label-propagation and structural-entropy partitions on the raw graph."""
    edges = c.get("graph").select("a", "b", "weight")
    labels = {"structural_entropy": c.get("communities"), "label_propagation": community.detect(edges, c.users(), "label_propagation", key="user_id")}
    if c.has("baseline_kmeans"):
        labels["kmeans"] = c.get("baseline_kmeans").selectExpr("user_id as node", "community_id as community")
    return {name: community.partition_quality(edges, df).first().asDict() for name, df in labels.items()}


@command("summarize-external-baselines")
def summarize_external(c: Corpus, a: argparse.Namespace) -> dict:
    names = [n for n in ("logistic", "forest", "deepwalk", "node2vec", "kmeans") if c.has(f"baseline_{n}_metrics")]
    rows = experiments.baseline_summary({n: c.get(f"baseline_{n}_metrics") for n in names})
    return {r.method: r.asDict() for r in c.put(rows, "baseline_summary").collect()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="murmur", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        p.add_argument("--sample-root", required=True)
        for key, value in options.items():
            p.add_argument(f"--{key.replace('_', '-')}", type=type(value), default=value)
    return top


def run(spark: SparkSession, argv: list[str]) -> Any:
    a = parser().parse_args(argv)
    out = COMMANDS[a.command][0](Corpus(spark, a.sample_root), a)
    sinks.write_json(spark, f"{a.sample_root}/analysis/{a.command}.json", {"command": a.command, "parameters": {k: v for k, v in vars(a).items() if k != "command"}, "result": out})
    return out


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("murmur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:]), indent=2, default=str))


if __name__ == "__main__":
    main()
