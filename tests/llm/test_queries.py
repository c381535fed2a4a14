"""The registered queries, against their SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from chartloom.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(queries.ORACLES[name])
    ours = queries.queries()[name](spark, str(SF)).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())


def test_a_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
