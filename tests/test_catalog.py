"""All registered queries of the engine against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tallyrill import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((repr(r) for r in cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select([f"`{c}`" for c in names]).collect()) == want
