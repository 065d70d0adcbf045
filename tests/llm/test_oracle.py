import glob
import os

import duckdb
import pytest

from skein.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})")
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(cur.fetchall())
