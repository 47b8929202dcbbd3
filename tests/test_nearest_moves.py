"""Top-k cosine: every vector moves once a task, ties by id whatever the tasks, and nothing else moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import graph


def plain(ids, m, k):
    """Each id's k best by twelve places and then id."""
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    s = np.round(unit @ unit.T, 12)
    out = {}
    for r, x in enumerate(ids):
        order = sorted((-s[r, c], y) for c, y in enumerate(ids) if y != x)[:k]
        out |= {(x, y): (n + 1, round(-w, 9)) for n, (w, y) in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_nearest_equal_a_plain_version(spark, monkeypatch, kind):
    """Copies in all blocks, negative numbers, texts whose order is not that of the numbers in them."""
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(size=(120, 8)), np.repeat(rng.normal(size=(2, 8)), 40, axis=0)]).astype(np.float32)
    ids = list(range(-60, 140)) if kind == "bigint" else [f"u{k}" for k in range(200)]
    rows = spark.createDataFrame(list(zip(ids, m.tolist(), strict=True)), f"id {kind}, vector array<float>").repartition(3)
    want = plain(ids, m.astype(np.float64), 5)
    monkeypatch.setattr(graph, "PRODUCTS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        for block in (graph.BLOCK, 30, 1):
            got = {(r.source, r.target): (r["rank"], round(r.weight, 9)) for r in graph.cosine_topk(rows, 5, block=block).collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_move_once_a_task(spark):
    """Rows handed out are in proportion to the vectors, not to their square, and one exchange is all."""
    rows = spark.range(20_000).select("id", F.array(F.sin(F.col("id")), F.cos(F.col("id") * 3)).alias("vector"))
    found = graph.cosine_topk(rows, 2, rows=20_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert found.count() == 40_000
    assert graph.cosine_topk(rows.limit(0), 2).count() == 0
