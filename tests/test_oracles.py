"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from hourline import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = [[r[c] for c in cols] for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    got = con.execute(catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in got.fetchall()]
    assert plain(rows) == plain(want)
