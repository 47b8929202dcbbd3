"""Jaccard of sets as bits: the same as of arrays, and no set operation a pair."""

import itertools

import pytest
from pyspark.sql import functions as F

from murmur.functions import vectors as V
from murmur.plans import catalog


def test_bits_equal_sets(spark):
    """Repeated, null and no members, both ends of a word, the largest value."""
    sets = {1: [0, 63, 64, 98, 98], 2: [63, None], 3: [None], 4: list(range(99)), 5: [64, 65, 66], 6: [1, None, 64]}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k int, v int")
    bits = V.bit_sets(rows, "k", F.col("v"), 99)
    got = bits.selectExpr("k as a", "bits as x").crossJoin(bits.selectExpr("k as b", "bits as y")).select("a", "b", V.jaccard_of_bits("x", "y", 2).alias("j")).collect()
    found = {(r.a, r.b): r.j for r in got}
    for a, b in itertools.product(sets, sets):
        x, y = ({v for v in sets[k] if v is not None} for k in (a, b))
        assert found[a, b] == (len(x & y) / len(x | y) if x | y else None)


def test_other_values_raise(spark):
    rows = spark.createDataFrame([(1, 99)], "k int, v int")
    with pytest.raises(Exception, match="not within the set"):
        V.bit_sets(rows, "k", F.col("v"), 99).collect()


def test_pairs_take_no_set_operations_and_a_nation_is_cut(spark, tmp_path):
    """Negative keys too: their remainders are negative."""
    spark.createDataFrame([(k, p) for k in range(40) for p in range(-(k % 7) - 3, k)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 1) for k in range(40)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.jaccard_pairs(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_union" not in plan
    sets = {k: set(range(-(k % 7) - 3, k)) for k in range(40)}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(range(40), 2)}
