"""Every query with SQL beside it gives the rows of that SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from chartloom.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _row(r):
    return tuple("~" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    ours = QUERIES[name](spark, str(SF))
    theirs = con.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted(_row(r) for r in ours.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(_row(r) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_arithmetic_on_large_keys(spark, tmp_path):
    """Sums beyond 2^53 / 10^4, where the SQL's rounding to four digits moves the last digits of a double."""
    source = SF / "orders.parquet"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (o_orderkey + i * 1000000000000 AS o_orderkey, o_custkey + i * 1000000000000 AS o_custkey) FROM '{source}', range(0, 60, 15) r(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = sorted(map(tuple, QUERIES["formula_arithmetic"](spark, str(tmp_path)).select("o_orderkey", "a", "b", "c", "d").collect()))
    assert got == sorted(con.sql(ORACLES["formula_arithmetic"]).fetchall())
