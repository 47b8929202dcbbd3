"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import pytest

from murmur.plans import catalog, small  # noqa: F401
from tests.conftest import DATA, canonical


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert canonical(rows) == canonical([tuple(getattr(x, "item", lambda x=x: x)() for x in r) for r in want[columns].itertuples(index=False)])


@pytest.mark.parametrize("name", ["seed_selection", "downsample_selection", "dtw_pairs", "encoding_tree", "kmeans_groups", "deepwalk", "node2vec_walks"])
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
