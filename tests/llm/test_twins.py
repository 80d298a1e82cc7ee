"""Corpus queries against their SQL twins."""

import duckdb
import pytest

from peakflow.llm import registry

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_decontaminate", "op7_quality"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    want = con.sql(registry.ORACLE_SQL[name]).select(*df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
