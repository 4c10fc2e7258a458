"""Every registered query against its SQL twin on the smallest tables, and plan rules."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_file
from entitle.plans.registry import QUERIES

SMALL = entry_file.SMALL
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
PYTHON_NODES = {"l2_redact_nested", "q2_dense_top_k", "q2_dense_top_k_in_category", "q7_similar_items",
                "q7_similar_vectors", "q8_item_details"}


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def tidy(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = [tuple(None if v is None or v is pd.NaT or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
                    for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(values, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = entry_file.queries()[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_NODES:
        assert "Python" not in plan and "InPandas" not in plan
    found = frame.toPandas()
    assert len(found) > 0
    if name in entry_file.oracle_sql():
        want = duck.execute(entry_file.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert tidy(found) == tidy(want)


def test_entry(spark):
    assert entry_file.entry(spark).columns == ["user_id", "section", "rank", "scheme_id", "match_score", "section_total"]


def test_worker_functions_travel_with_the_job():
    from pyspark import cloudpickle

    from entitle.operators import search
    assert "entitle" in cloudpickle.list_registry_pickle_by_value()
    assert b"argsort" in cloudpickle.dumps(search.nearest)
