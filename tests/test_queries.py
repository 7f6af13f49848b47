import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from rankloom.plans.oracles import oracle_sql
from rankloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(SQL) == {"train_and_score", "tune_best", "feature_importance", "top_features"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    assert compare(spark, tables, QUERIES[name], SQL[name], FOLDER) == []


# tune_checks runs the grid of tune_best; test_runs.py covers the search with a small one.
@pytest.mark.parametrize("name", ["train_and_score", "feature_importance", "top_features"])
def test_model_query_runs(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()
