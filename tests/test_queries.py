"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from voxelmill.jobs import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(df):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got)  # no query proves anything without rows
    if name in queries.SQL:
        want = db.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
