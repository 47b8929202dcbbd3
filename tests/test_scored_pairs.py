"""Scores of pairs: equal to the column functions where parts are missing, and bundles move once a task, not once a pair."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from murmur.functions import vectors as V
from murmur.operators import graph

SCHEMA = "user_id string, embedding array<double>, behaviour array<double>, type_mix array<double>, hours array<double>, degrees_unit array<double>, followed array<string>"


def bundles(spark):
    r = random.Random(3)
    some = lambda x: x if r.random() < 0.75 else None
    users = [f"u{k}" for k in range(30)]
    floats = lambda n: [r.uniform(-1, 1) for _ in range(n)]
    rows = [(u, some(floats(4)), some(floats(2)), [float(r.randrange(3)) for _ in range(5)], some([r.random() for _ in range(r.choice([3, 6]))]), some(floats(2)), r.sample(users + ["x1", "x2"], r.randrange(6))) for u in users]
    rows[4] = ("u4", [0.0] * 4, None, [0.0] * 5, None, None, [])
    rows[5] = ("u5", None, None, [0.0] * 5, None, None, [])
    return spark.createDataFrame(rows, SCHEMA), users


def test_scores_equal_the_column_functions(spark):
    b, users = bundles(spark)
    pairs = [(x, y) for x, y in itertools.product(users, users) if (int(x[1:]) * 7 + int(y[1:])) % 3] + [("u1", "u2"), ("u2", "u1"), ("u1", "u2"), ("u4", "u5"), ("u3", "gone"), ("gone", "u3")]
    p = spark.createDataFrame(pairs, "source string, target string")
    wide = p.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    for side in "ab":
        wide = wide.join(b.select(*[F.col(c).alias(side if c == "user_id" else f"{side}_{c}") for c in b.columns]), side)
    unit = lambda c: V.unit_cosine(f"a_{c}", f"b_{c}")
    want = wide.select(
        "a", "b", unit("embedding").alias("content"), V.combine(V.js_similarity("a_type_mix", "b_type_mix"), unit("behaviour")).alias("behaviour"),
        (1 / (1 + V.dtw_average_distance("a_hours", "b_hours"))).alias("temporal"), V.combine(V.jaccard("a_followed", "b_followed"), unit("degrees_unit"), 0.7, 0.3).alias("network"),
    )
    key = lambda rows: {(r.a, r.b): [None if r[c] is None else pytest.approx(r[c], abs=1e-9) for c in graph.CHANNELS] for r in rows}
    got = graph.score_pairs(p, b).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): [r[c] for c in graph.CHANNELS] for r in got} == key(want.collect())
    assert {r.channels for r in got} >= {0, 4} or any(r.channels < 4 for r in got)


def test_a_pair_moves_as_two_numbers(spark):
    """Nothing is joined once bundles are known by number, and rows handed out are pairs and tasks times bundles."""
    b, users = bundles(spark)
    known = graph._known(b)
    pairs = graph._by_number(spark.createDataFrame([("u1", "u2"), ("u2", "u3")], "source string, target string"), known)
    pairs = graph.written(pairs, "pairs")
    plan = graph._scored(pairs, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert graph._scored(pairs, known).count() == 2
