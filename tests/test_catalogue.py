"""Every registered query against its SQL on DuckDB: columns and rows, in any order."""

import glob
import os

import duckdb
import pytest

from skein.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted((tuple(norm(dict(zip(cols, r, strict=True))[c]) for c in names) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("odd", ["CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text", "CASE WHEN doc_id % 50 = 0 THEN NULL ELSE text END AS text", "CASE WHEN doc_id % 50 = 0 THEN 7 ELSE doc_id END AS doc_id", "CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id END AS doc_id"], ids=["empty text", "no text", "repeated id", "no id"])
def test_blob_column_counts_of_odd_documents(odd, spark, sf, duck, tmp_path):
    duck.execute(f"COPY (SELECT * REPLACE ({odd}) FROM documents) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = QUERIES["blob_column_counts"](spark, str(tmp_path)).first()
    want = duck.execute(SQL["blob_column_counts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).fetchone()
    assert (got["blobs"], got["rows"], got["bytes"]) == want
