"""Every query of the registry with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import pandas as pd
import pytest

from lexiquarry import plans
from lexiquarry.registry import ORACLES, QUERIES

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    out = pd.DataFrame({c: [one(v) for v in df[c].tolist()] for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(plain(got), plain(want))


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
