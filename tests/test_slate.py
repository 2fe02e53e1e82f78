"""The slate against DuckDB on sf0.001."""

import duckdb
import pytest

from quern.queries import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(table, names):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_slate(spark, con, name):
    mine, other = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    names = sorted(mine.column_names)
    assert names == sorted(other.column_names)
    assert rows(mine, names) == rows(other, names)
