"""Walks: a task that holds the graph, joins and a plain version give the same."""

import hashlib

import pytest
from pyspark.sql import functions as F

from murmur.operators import experiments


def plain(near, number, length, seed, p, q):
    """Walk after walk, neighbour after neighbour."""
    out = {}
    for start in near:
        for nth in range(1, number + 1):
            walk = [start]
            for step in range(1, length):
                after = sorted(near.get(walk[-1], []))
                if not after:
                    break
                h = int(hashlib.sha1(f"{seed}|{start}|{nth}|{step}".encode()).hexdigest()[:12], 16)
                if p == q == 1.0:
                    walk.append(after[h % len(after)])
                    continue
                before = walk[-2] if len(walk) > 1 else None
                weights = [1.0 if before is None else 1 / p if x == before else 1.0 if x in near.get(before, []) else 1 / q for x in after]
                cut, sofar, chosen = sum(weights) * (h / 16**12), 0.0, after[-1]
                for x, w in zip(after, weights, strict=True):
                    sofar += w
                    if sofar > cut:
                        chosen = x
                        break
                walk.append(chosen)
            out[start, nth] = walk
    return out


@pytest.mark.parametrize("kind", ["string", "bigint"])
@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.5, 2.0), (0.3, 0.7)])
def test_walks_equal_a_plain_version(spark, monkeypatch, kind, p, q):
    """A ring with chords, a hub, an end without neighbours of its own, and a node that is nobody's neighbour."""
    name = (lambda k: f"u{k}") if kind == "string" else int
    links = {k: {(k + 1) % 40, (k - 1) % 40, (k * 7) % 40, 50} - {k} for k in range(40)}
    links |= {50: set(range(40)), 60: {50, 70}}
    near = {name(k): [name(x) for x in v] for k, v in links.items()}
    rows = spark.createDataFrame(list(near.items()), f"node {kind}, neighbours array<{kind}>")
    monkeypatch.setattr(experiments, "WALK_BLOCK", 7)
    monkeypatch.setattr(experiments, "WALK_CELLS", 50)
    want = plain(near, 3, 12, 42, p, q)
    for most in (10**6, 0):  # in tasks, in joins
        monkeypatch.setattr(experiments, "WALK_EDGES", most)
        got = {(r.node, r.nth): r.walk for r in experiments.walks(rows, 3, 12, p=p, q=q).collect()}
        assert got == want


def test_steps_move_nothing(spark):
    """No join follows the handing out of the graph, however many steps there are."""
    near = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "node string, neighbours array<string>")
    plan = experiments.walks(near, 2, 30, p=0.5, q=2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6
    assert experiments.walks(near, 2, 30, p=0.5, q=2.0).where(F.size("walk") == 30).count() == 4
