"""Every query against its SQL twin."""

import math

import duckdb
import pytest

from peakflow import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isnan(p) and math.isnan(q)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_store_info_twin_beyond_a_million_tofs(spark, tmp_path):
    """The twin ranks buckets by peaks * 1,000,000 + tof: the one of two peaks here outranks the one of three."""
    c = duckdb.connect()
    tofs = "(VALUES (5), (5), (5), (1500000), (1500000), (700000)) t(k)"
    c.sql(f"copy (select k::bigint as l_partkey, 1::bigint as l_suppkey, q::integer as l_linenumber, 3.0::double as l_quantity, timestamp '1995-03-01' as l_shipdate from {tofs}, range(1, 4) r(q)) to '{tmp_path}/lineitem.parquet'")
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.sql(registry.ORACLE_SQL["store_info"])
    got = registry.QUERIES["store_info"](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == rows and rows[0][want.columns.index("largest_tof")] == 1_500_000
