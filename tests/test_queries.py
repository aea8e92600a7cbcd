"""Every registered query of the library against its DuckDB counterpart, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from leafmill.plans.registry import ORACLES, QUERIES
from leafmill.sources.tables import SCHEMAS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(9)
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(found) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(found), normal(want))
