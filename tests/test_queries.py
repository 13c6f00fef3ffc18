"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from larder.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for n in TABLES:
        con.sql(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    r = con.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=lambda r: tuple(map(str, r)))
    assert ours == theirs


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()
