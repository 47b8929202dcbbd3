"""Agglomeration by mutual best pairs goes on until no merger gains."""

import math

from murmur.operators import community


def test_hub_is_finished(spark):
    """A hub of 100 leaves merges with one a round for more than 40 rounds."""
    leaves = 100
    edges = spark.createDataFrame([("h", f"l{k:03d}", 1.0) for k in range(leaves)], "a string, b string, weight double")
    total = 2.0 * leaves
    term = lambda v, i: -(v - 2 * i) / total * math.log2(v / total) + v / total * math.log2(v)
    v, i, merged = float(leaves), 0.0, 0
    while merged < leaves and term(v, i) + term(1.0, 0.0) - term(v + 1, i + 1) > community.EPS:
        v, i, merged = v + 1, i + 1, merged + 1
    assert merged > 40
    sizes = [r["count"] for r in community.mutual_best(edges).groupBy("community").count().collect()]
    assert sorted(sizes) == [1] * (leaves - merged) + [merged + 1]


def test_rounds_in_joins_and_over_arrays_are_the_same(spark, monkeypatch):
    """Two components, equal weights (ties), a hub; joins to the end, arrays from the start, and joins for the first rounds only."""
    rows = [(f"n{k:02d}", f"n{(k * m + 1) % 60:02d}", 1.0 + (k * m) % 3) for k in range(60) for m in (1, 3, 7)]
    rows = {(min(a, b), max(a, b)): w for a, b, w in rows if a != b} | {("p0", f"p{k}"): 1.0 for k in range(1, 6)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a string, b string, weight double")
    found = []
    for most in (10**6, 100, 0):
        monkeypatch.setattr(community, "LARGEST", most)
        found.append({r.node: r.community for r in community.mutual_best(edges).collect()})
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 66 and len(set(found[0].values())) < 66


def test_arrays_take_no_more_jobs_for_more_rounds(spark):
    """A hub of 60 leaves takes as many jobs as a pair: rounds are not jobs."""

    def jobs(leaves):
        spark.sparkContext.setJobGroup(f"leaves-{leaves}", "mutual best")
        community.mutual_best(spark.createDataFrame([("h", f"l{k:03d}", 1.0) for k in range(leaves)], "a string, b string, weight double")).collect()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"leaves-{leaves}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs(60) == jobs(1)
