"""The training-data queries that SQL can express, against it."""

from pathlib import Path

import duckdb
import pytest

from metricloom.llm.queries import QUERIES, SQL
from tools.check_oracle import canon

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="bundled tables not present")
@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = canon(QUERIES[name](spark, SF).toArrow()), canon(con.sql(SQL[name]).to_arrow_table())
    assert got == want
