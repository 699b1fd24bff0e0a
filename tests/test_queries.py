"""Every registered query next to its SQL on the smallest tables."""

import pathlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, mine = rows_of(df.columns, df.collect())
    if name in SQL:
        res = con.execute(SQL[name])
        assert (columns, mine) == rows_of([d[0] for d in res.description], res.fetchall())
