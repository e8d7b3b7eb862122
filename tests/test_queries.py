"""Every query against its SQL twin, over the whole small tables."""

import oracle
import pytest

from stratalens.queries.oracle_queries import ORACLE
from stratalens.queries.spark_queries import QUERIES

MODEL_QUERIES = {"rf_predictions", "gbt_scores"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_an_oracle_but_the_fitted_ones():
    assert set(QUERIES) - set(ORACLE) == MODEL_QUERIES
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


def test_comparison_notices_a_changed_value(spark, sf_dir, duck):
    sql = ORACLE["violations_by_type"].replace("count(*) AS files", "count(*)+1 AS files")
    assert oracle.differences(QUERIES["violations_by_type"](spark, sf_dir), duck, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
