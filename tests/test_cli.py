"""All commands in order over a small corpus folder."""

import json
import os
import random
import shutil
import tempfile
from pathlib import Path

import pytest

from murmur import cli
from murmur.operators import community
from murmur.sources.corpus import Corpus

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


class Client:
    """Deterministic: embeds by letters, answers with one triplet and an original post."""

    def embed(self, texts):
        return [[float(t.count(c)) + 0.1 for c in "abcdegh"] for t in texts]

    def complete(self, system, user):
        return '{"coarse_type": "original", "detail_type": "original", "confidence": 0.8, "triplets": [{"subject": "a", "predicate": "b", "object": "c"}]}'


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng, root = random.Random(1), tmp_path_factory.mktemp("corpus")
    users, tweets, edges, splits, labels = [], [], [], ["id,split"], ["id,label"]
    for i in range(40):
        bot = i % 2
        users.append({"id": str(i), "username": f"n{i}", "description": " ".join(rng.choices(WORDS[4 * bot : 4 * bot + 4], k=5)), "verified": not bot, "public_metrics": {"followers_count": 5 + 100 * (1 - bot) + i, "following_count": 3 * i, "tweet_count": 9 + i}})
        splits.append(f"{i},{('train', 'train', 'dev', 'test')[i // 2 % 4]}")
        labels.append(f"u{i},{'bot' if bot else 'human'}")
        for k in range(10):
            tid = f"t{i}_{k}"
            refs = [{"id": f"t{(i + 1) % 40}_0", "type": "retweeted"}] if bot and k % 2 else []
            tweets.append({"id": tid, "author_id": i, "text": " ".join(rng.choices(WORDS, k=6)), "created_at": f"2021-03-{k + 1:02d}T{(8 if bot else 20) + k % 3:02d}:00:00Z", "lang": "en", "referenced_tweets": refs, "entities": {"urls": [{"expanded_url": "https://a.org"}] if k == 0 else []}, "public_metrics": {"like_count": 1}})
            edges.append((f"u{i}", tid, "post"))
            if refs:
                edges.append((tid, refs[0]["id"], "retweeted"))
        for j in rng.sample([x for x in range(40) if x % 2 == bot and x != i], 4):
            edges.append((f"u{i}", f"u{j}", rng.choice(["following", "follower"])))
    (root / "user.json").write_text(json.dumps(users))
    (root / "tweet_0.jsonl").write_text("\n".join(map(json.dumps, tweets[:200])))
    (root / "tweet_1.json").write_text(json.dumps(tweets[200:]))
    (root / "edge.csv").write_text("source_id,target_id,relation\n" + "\n".join(",".join(e) for e in edges))
    (root / "split.csv").write_text("\n".join(splits))
    (root / "label.csv").write_text("\n".join(labels))
    return root


def test_commands(spark, corpus):
    run = lambda name, *args, at=corpus: cli.run(spark, [name, "--sample-root", str(at), *args])
    assert run("profile") == {"users": 40}
    small = corpus.parent / "small"
    made = run("sample", "--size", "20", "--out", str(small))
    assert 20 <= made["users"] <= 40
    assert run("validate", "--target-root", str(corpus), at=small)["endpoint_errors"] == 0
    down = corpus.parent / "down"
    assert run("downsample-final", "--target-users", "10", "--out", str(down)) == {"users": 10}
    assert run("audit")["summary"]["tweets"] == 400
    client = f"{__name__}:Client"
    assert run("classify-post-types", "--client", client) == {"tweets": 400, "errors": 0}
    assert run("extract-triplets", "--client", client, "--max-tweets", "60")["errors"] == 0
    assert run("build-user-features") == {"users": 40}
    assert run("build-user-vectors", "--client", client, "--dims", "7") == {"users": 40}
    assert run("build-temporal-profiles") == {"users": 40}
    assert run("build-user-graph", "--fusion", "early", "--k", "3", "--dims", "7")["edges"] > 0
    assert run("build-user-graph", "--k", "4", "--candidate-k", "10")["edges"] > 0
    assert run("detect-communities")["communities"] < 40
    scores = run("evaluate-communities")
    assert next(m for m in scores["metrics"] if m["split"] == "test")["accuracy"] > 0.8
    assert run("evaluate-community-purity")["global_purity"] > 0.8
    purity = spark.read.parquet(str(corpus / "analysis" / "purity_profiles")).collect()
    assert all(r.encoding_depth >= 0 and r.exact_subtree is not None for r in purity)
    assert sum(run("analyze-community-structure")["archetypes"].values()) > 0
    sweep = ("sweep-community-pipeline", "--ks", "4", "--similarities", "0", "--sizes", "1", "--thresholds", "0.3,0.5")
    assert run(*sweep)["runs"] == 2 and run(*sweep)["runs"] == 2
    best = run("finalize-best-community-run")["best"]
    assert best["valid_f1"] > 0.8
    final = spark.read.parquet(str(corpus / "analysis" / "final" / "profiles"))
    assert final.count() == best["communities"] and spark.read.parquet(str(corpus / "analysis" / "final" / "assignments")).count() == 40
    assert run("analyze-community-errors")["uncertain"] > 0
    assert run("train-community-reranker", "--epochs", "3")["epochs"] == 3
    assert run("analyze-community-reranker")["unchanged_right"] > 0
    run("run-feature-baselines", "--cs", "1", "--trees", "3", "--depths", "3")
    run("run-kmeans-baseline", "--ks", "2", "--starts", "1")
    assert set(run("summarize-grouping-baselines")) == {"structural_entropy", "label_propagation", "kmeans"}
    assert set(run("summarize-external-baselines")) == {"logistic", "forest", "kmeans"}
    assert json.loads((corpus / "analysis" / "audit.json").read_text())["command"] == "audit"


class Failing(Client):
    """Answers a post in two at first: those whose text has an even length."""

    def complete(self, system, user):
        if not Path(user_marker()).exists() and len(user) % 2:
            return "no answer"
        return super().complete(system, user)


def user_marker():
    return str(Path(tempfile.gettempdir()) / f"murmur-answers-{os.getuid()}")


def test_service_stages_resume_and_keep_dead_letters(spark, corpus, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    for f in corpus.iterdir():
        if f.is_file():
            shutil.copy(f, root)
    ask = lambda: cli.run(spark, ["extract-triplets", "--sample-root", str(root), "--client", f"{__name__}:Failing", "--max-tweets", "60"])
    Path(user_marker()).unlink(missing_ok=True)
    first = ask()
    assert 0 < first["errors"] < first["tweets"] == 60
    letters = lambda: spark.read.json(str(root / "analysis" / "triplets_errors.jsonl"))
    assert letters().count() == first["errors"] and letters().where("error is null").count() == 0
    Path(user_marker()).touch()
    try:
        assert ask() == {"tweets": 60, "errors": 0}  # only those that failed are asked again
    finally:
        Path(user_marker()).unlink()
    done = spark.read.json(str(root / "analysis" / "triplets.jsonl"))
    assert done.count() == done.select("tweet_id").distinct().count() == 60
    assert ask() == {"tweets": 60, "errors": 0}  # nothing is left to ask


def test_depths_of_communities_and_copy_of_the_best_run(spark, tmp_path):
    c = Corpus(spark, str(tmp_path))
    ends = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)]
    c.put(community.encoding_tree(spark.createDataFrame(ends, "a string, b string, weight double")), "tree")
    c.put(spark.createDataFrame([(u, "c1" if u in "abc" else "c2") for u in "abcdef"] + [("z", "c3")], "user_id string, community_id string"), "assignments")
    profiles = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "community_id string")
    got = {r.community_id: (round(r.encoding_depth, 6), r.exact_subtree) for r in cli._encoded(c, profiles).collect()}
    assert got == {"c1": (2.666667, True), "c2": (2.666667, True), "c3": (0.0, False)}
    for name in cli.RUN_TABLES:
        c.put(profiles, f"runs/r1/{name}")
    c.put(spark.createDataFrame([("r1", 0.9, 0.8, 3)], "name string, valid_f1 double, valid_auc double, communities int"), "sweep")
    c.put(spark.createDataFrame([("c1", 0.5, 3)], "community_id string, bot_score double, community_size int"), "scores_profiles")
    assert cli.run(spark, ["finalize-best-community-run", "--sample-root", str(tmp_path)])["best"]["name"] == "r1"
    assert c.get("final/predictions").count() == 3


def test_every_command_is_there():
    assert len(cli.COMMANDS) == 25
