"""Registered queries do the reference's whole job, not a smaller one."""

from murmur.operators import graph
from murmur.plans import bindings as B
from murmur.plans import catalog
from tests.conftest import DATA


def test_late_fusion_takes_the_reference_candidates(spark):
    d = f"{DATA}/sf0.01"
    want = graph.late_fusion(catalog.written(catalog._bundles(spark, d), "bundles"), B.follows(spark, d).distinct(), k=5, candidate_k=100)["edges"]
    got = catalog.QUERIES["late_fusion_graph"](spark, d)
    assert {(r.a, r.b) for r in got.collect()} == {(r.a, r.b) for r in want.collect()}


def test_walks_are_ten_of_forty_nodes(spark):
    for name in ("deepwalk", "node2vec_walks"):
        rows = catalog.QUERIES[name](spark, f"{DATA}/sf0.001").collect()
        assert max(r.nth for r in rows) == 10
        assert {len(r.walk.split(" ")) for r in rows} == {40}
