"""Every core query that has SQL gives the rows of its SQL."""

import pytest

from seriesloom.plans import queries
from tests.duck import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck(queries.oracle_sql()[name], SF)


def test_trained_indexes(spark):
    found = queries.queries()["ivf_trained"](spark, SF).collect()
    exact = queries.queries()["knn_l2"](spark, SF).collect()
    assert len({r["id"] for r in found} & {r["id"] for r in exact}) >= 8
    pq = queries.queries()["pq_trained"](spark, SF).first()
    assert 0 < pq["error"] < pq["norm"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
