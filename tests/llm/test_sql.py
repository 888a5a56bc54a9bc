"""The registered SQL of this subpackage against its queries, on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pytest

from kinetrail.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_spark_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    rows = {tuple(r) for r in con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()}
    got = QUERIES[name](spark, str(DATA)).select(*columns).collect()
    assert {tuple(r) for r in got} == rows and len(got) == len(rows)
