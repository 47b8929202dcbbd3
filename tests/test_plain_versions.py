"""Sequential and iterative operators against plain versions; times in sessions of several zones; failures of the service."""

import hashlib
import math
import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.operators import community, enrich, experiments, features, graph
from murmur.streaming import profiles

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def at(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp())


TIMES = {
    "Wed, 21 Oct 2015 07:28:00 GMT": at(2015, 10, 21, 7, 28), "21 Oct 2015 07:28:00 +0530": at(2015, 10, 21, 1, 58), "Wed, 21 Oct 2015 07:28:00 EST": at(2015, 10, 21, 12, 28), "Wed, 1 Oct 2015 07:28:00 -0000 (GMT)": at(2015, 10, 1, 7, 28),
    "Wed Oct 10 20:19:24 +0000 2018": at(2018, 10, 10, 20, 19, 24), "Wed Oct 10 20:19:24 UTC 2018": at(2018, 10, 10, 20, 19, 24), "21 Oct 2015 07:28:00": at(2015, 10, 21, 7, 28),
    "2020-01-01T00:00:00": at(2020, 1, 1), "2020-01-01 05:06:07.250": at(2020, 1, 1, 5, 6, 7), "2020-01-01": at(2020, 1, 1), "2020-01-01T00:00:00Z": at(2020, 1, 1), "2020-01-01T00:00:00.000Z": at(2020, 1, 1),
    "2020-01-01T00:00:00+02:00": at(2019, 12, 31, 22), "2020-01-01T00:00:00-0330": at(2020, 1, 1, 3, 30), "yesterday": None, "": None, None: None, "2020-13-01T00:00:00": None,
}


def test_timestamps_are_utc(spark, zone):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", F.unix_seconds(N.parse_timestamp("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == TIMES


def test_hours_are_utc(spark, zone):
    rows = spark.createDataFrame([("a", s) for s in (0, 3600 * 5, 3600 * 23 + 59, -1, at(2015, 7, 1, 13))], "user_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = [1 if h in (0, 5, 13) else 2 if h == 23 else 0 for h in range(24)]
    assert features.hour_histogram(rows, "ts").first().hours == want
    assert profiles.hour_profiles(rows).first().hours == want
    naive = spark.sql("select 'a' user_id, timestamp_ntz'2015-07-01 13:30:00' ts")
    assert features.hour_histogram(naive, "ts").first().hours[13] == 1


def test_streamed_times_are_utc(spark, zone, tmp_path):
    spark.sql("select 1L event_id, timestamp_ntz'2015-07-01 13:30:00' ts, 7L user_id, 'x' event_type, 1.0D value, '' props").write.parquet(str(tmp_path / "in"))
    query = profiles.read_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(f"z{ZONES.index(zone)}").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql(f"select unix_seconds(ts) s from z{ZONES.index(zone)}").first().s == at(2015, 7, 1, 13, 30)


# --- communities -----------------------------------------------------------------------------------------------------------------------------


def some_graph(seed, n=60, p=0.08, weights=(0.25, 0.5, 1.0)):
    rng = random.Random(seed)
    near = {f"n{i:02d}": {} for i in range(n)}
    for a in near:
        for b in near:
            if a < b and rng.random() < (p * 4 if int(a[1:]) // 15 == int(b[1:]) // 15 else p / 4):
                near[a][b] = near[b][a] = rng.choice(weights)
    return {x: m for x, m in near.items() if m}


def digest(seed, step, text):
    return hashlib.sha1(f"{seed}:{step}:{text}".encode()).hexdigest()


def pull(near, label, x, allowed=lambda c: True):
    total = {}
    for y, w in near[x].items():
        if allowed(label[y]):
            total[label[y]] = total.get(label[y], 0) + w
    return total


@pytest.mark.parametrize("seed", range(8))
def test_propagation_visits_nodes_one_by_one(seed):
    near = some_graph(seed)
    label = {x: x for x in near}
    for step in range(1, 21):
        old = dict(label)
        for x in sorted(near, key=lambda x: (-len(near[x]), digest(seed, step, x))):
            total = pull(near, label, x)
            heaviest = {c for c in total if total[c] == max(total.values())}  # weights are exact in binary
            if label[x] not in heaviest:
                label[x] = min(heaviest, key=lambda c: digest(seed, step, f"{x}:{c}"))
        if label == old:
            break
    assert community.propagate(near, 20, seed) == (label, step)


@pytest.mark.parametrize(("seed", "least"), [(s, k) for s in range(4) for k in (2, 4, 9)])
def test_small_communities_move_one_member_at_a_time(seed, least):
    near = some_graph(seed)
    label = community.propagate(near, 1, seed)[0]
    start = list(label.values())
    large = {c for c in start if start.count(c) >= least}
    want = dict(label)
    for x in sorted((x for x in near if label[x] not in large), key=lambda x: digest(seed, 9999, x)):
        total = pull(near, want, x, large.__contains__)
        if total:
            want[x] = min((c for c in total if total[c] == max(total.values())), key=lambda c: digest(seed, 10000, f"{x}:{c}"))
    assert community.merge_small(near, label, least, seed) == want


def entropy(near, groups, total):
    out = 0.0
    for g in groups:
        volume = sum(sum(near[x].values()) for x in g)
        inside = sum(w for x in g for y, w in near[x].items() if y in g)  # twice the inner weight
        out += -(volume - inside) / total * math.log2(volume / total) + volume / total * math.log2(volume)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_agglomeration_takes_the_best_merge_each_time(seed):
    near = some_graph(seed, n=16, p=0.2, weights=(0.31, 0.57, 0.83, 1.01, 0.77))
    total = sum(sum(m.values()) for m in near.values())
    groups = [frozenset([x]) for x in near]
    while True:
        now = entropy(near, groups, total)
        best = None
        for i, a in enumerate(groups):
            for b in groups[i + 1 :]:
                if any(y in b for x in a for y in near[x]):
                    gain = now - entropy(near, [g for g in groups if g not in (a, b)] + [a | b], total)
                    if best is None or gain > best[0]:
                        best = (gain, a, b)
        if best is None or best[0] <= 1e-12:
            break
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]
    label, tree = community.agglomerate(near, total)
    assert {frozenset(x for x in label if label[x] == c) for c in label.values()} == set(groups)
    merges = [r for r in tree if r[1] == "merge"]
    assert merges[-1][-1] == pytest.approx(entropy(near, groups, total), abs=1e-9)


def test_a_component_too_large_for_a_task_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(community, "LARGEST", 3)
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}", 1.0) for i in range(4)], "a string, b string, weight double")
    with pytest.raises(ValueError, match="mutual_best"):
        community.by_component(edges)


# --- scoring, models, service ----------------------------------------------------------------------------------------------------------------


def test_late_fusion_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    n = 24
    users = [f"u{i:02d}" for i in range(n)]
    pick = lambda x, share: x if rng.random() < share else None
    mix = rng.dirichlet(np.ones(4), n)
    hours = rng.dirichlet(np.ones(24), n)
    rows = [(u, pick(rng.normal(size=6).tolist(), 0.8), rng.normal(size=5).tolist(), mix[i].tolist(), pick(hours[i].tolist(), 0.7), rng.normal(size=2).tolist(), sorted({users[j] for j in rng.integers(0, n, 4) if j != i})) for i, u in enumerate(users)]
    bundles = spark.createDataFrame(rows, "user_id string, embedding array<double>, behaviour array<double>, type_mix array<double>, hours array<double>, degrees_unit array<double>, followed array<string>").cache()
    follows = spark.createDataFrame([(u, v) for u, *_, f in rows for v in f], "source string, target string")
    got = graph.late_fusion(bundles, follows, k=3, candidate_k=4)
    by = {r[0]: r[1:] for r in rows}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    def js(a, b):
        m = (np.array(a) + b) / 2
        part = lambda p: sum(x * math.log2(x / y) for x, y in zip(p, m, strict=True) if x > 0)
        return 1 - (part(a) + part(b)) / 2

    pairs = {tuple(sorted((u, v))) for u, *_, f in rows for v in f}
    for k in (0, 1):
        own = {u: by[u][k] for u in users if by[u][k] is not None}
        for u in own:
            for v in sorted((v for v in own if v != u), key=lambda v: (-round(cos(own[u], own[v]), 12), v))[:4]:
                pairs.add(tuple(sorted((u, v))))
    scored = {(r.a, r.b): r for r in got["scored"].collect()}
    assert set(scored) == pairs
    unit = lambda x: (x + 1) / 2
    for (u, v), r in scored.items():
        a, b = by[u], by[v]
        content = None if a[0] is None or b[0] is None else unit(cos(a[0], b[0]))
        behaviour = 0.5 * js(a[2], b[2]) + 0.5 * unit(cos(a[1], b[1]))
        both, either = set(a[5]) & set(b[5]), set(a[5]) | set(b[5])
        network = 0.7 * len(both) / len(either) + 0.3 * unit(cos(a[4], b[4]))
        assert r.content == (None if content is None else pytest.approx(content, abs=1e-9)) and r.network == pytest.approx(network, abs=1e-9), (u, v)
        assert r.behaviour == pytest.approx(behaviour, abs=1e-9), (u, v)
        assert (r.temporal is None) == (a[3] is None or b[3] is None)
        parts = [x for x in (content, behaviour, r.temporal, network) if x is not None]
        assert r.weight == pytest.approx(sum(parts) / len(parts), abs=1e-9) and r.available_weight == pytest.approx(0.25 * len(parts))
    weight = {p: r.weight for p, r in scored.items()}
    edges = {}
    for u in users:
        mine = sorted(((-w, b if a == u else a) for (a, b), w in weight.items() if u in (a, b)))[:3]
        for w, v in mine:
            edges.setdefault(tuple(sorted((u, v))), set()).add(u)
    assert {(r.a, r.b): r.support for r in got["edges"].collect()} == {p: len(s) for p, s in edges.items()}


def test_gradient_descent_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=90) > 0).astype(float)
    split = np.array(["train"] * 60 + ["valid"] * 20 + ["test"] * 10)
    w, b, best, stale, epochs = np.zeros(4), 0.0, None, 0, 0
    tr, va = split == "train", split == "valid"
    for epochs in range(1, 61):
        p = 1 / (1 + np.exp(-(x[tr] @ w + b)))
        w, b = w - 0.5 * (x[tr].T @ (p - y[tr]) / 60 + 0.001 * w), b - 0.5 * (p - y[tr]).mean()
        q = np.clip(1 / (1 + np.exp(-(x[va] @ w + b))), 1e-8, 1 - 1e-8)
        loss = -(y[va] * np.log(q) + (1 - y[va]) * np.log(1 - q)).mean()
        if best is None or loss + 1e-9 < best[0]:
            best, stale = (loss, w, b), 0
        else:
            stale += 1
            if stale >= 5:
                break
    rows = spark.createDataFrame([(s, float(v), z.tolist()) for s, v, z in zip(split, y, x, strict=True)], "split string, y double, z array<double>")
    weights, bias, ran = experiments.logistic_gradient_descent(rows, 4, rate=0.5, epochs=60, patience=5)
    assert weights == pytest.approx(best[1].tolist(), abs=1e-8) and bias == pytest.approx(best[2], abs=1e-8) and ran == epochs


class Flaky:
    calls = 0

    def embed(self, texts):
        Flaky.calls += 1
        if "never" in texts or (Flaky.calls == 1 and "twice" in texts):
            raise ConnectionError("no answer")
        return [[float(len(t))] for t in texts]


def test_embedding_calls_are_retried_and_fail_by_batch(spark):
    rows = spark.createDataFrame([(0, "twice"), (1, "ok"), (2, "never"), (3, "x"), (4, None)], "i int, text string").coalesce(1).sortWithinPartitions("i")
    out = {r.i: r for r in enrich.embed(rows, Flaky, batch=2, pause=0.0).collect()}
    assert [out[k].embedding for k in range(5)] == [[5.0], [2.0], None, None, [0.0]]
    assert out[0].error is None and "no answer" in out[2].error and out[3].error and out[4].error is None
