"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from rxweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        assert canonical(got).equals(canonical(duck.sql(catalog.oracle_sql()[name]).df()))
    else:
        assert len(got)
