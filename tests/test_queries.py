"""Every query of the library: against its SQL on the smallest tables, or for rows at least."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from streakframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns) and len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        if pd.api.types.is_numeric_dtype(got[c]) and not pd.api.types.is_bool_dtype(got[c]):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=2e-6, err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
