"""Every named query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from proofline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted([tuple("null" if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
