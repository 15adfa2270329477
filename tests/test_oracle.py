"""Every registered query against its SQL oracle on the smallest tables (the driver repeats
this at sf0.01)."""
import pytest

from courtline.plans.catalog import REGISTRY
from oracle import compare, duck
from conftest import SF_SMALL

SQL_QUERIES = sorted(n for n, q in REGISTRY.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in REGISTRY.items() if not q.sql and n != "ml_train_eval")


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, con, name):
    res, _, _ = compare(spark, REGISTRY[name], SF_SMALL, con)
    assert res["ok"], res


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert REGISTRY[name].fn(spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
