"""The queries that SQL can state, against it; and the list of queries."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import canonical
from shelfspark.llm import queries


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, sf, name):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(
        cursor.fetchall(), columns)
