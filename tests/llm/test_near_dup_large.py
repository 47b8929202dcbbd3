"""Last-level nodes of more than LARGE documents: no pair is lost, whatever their smallest document is."""

import numpy as np
import pandas as pd
import pytest

from murmur.llm import near_dup
from murmur.operators.components import components


@pytest.mark.parametrize("like", [0, 1500])
def test_large_node_keeps_pairs_apart_from_its_smallest_document(spark, like):
    """One node; its smallest id is a bare template, `like` documents are copies of another sketch, and two pairs are alone."""
    rng = np.random.default_rng(7)
    count = near_dup.LARGE + 60
    sig = rng.integers(0, 1 << 32, (count, near_dup.HASHES), dtype=np.uint64).astype(">u4")
    sig[:, : near_dup.LEVELS] = 5
    sig[100 : 100 + like] = sig[100]
    sig[20], sig[2000] = sig[10], sig[1900]
    n = np.full(count, 100)
    n[0] = 84
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(count), "n": n, "sig": [s.tobytes() for s in sig]}))
    found = {r.node: r.component for r in components(near_dup.propose(rows, 1, 85)).collect()}
    want = {20: 10, 2000: 1900} | {k: 100 for k in range(101, 100 + like)}
    assert found == want
