"""Every corpus query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from convoy.llm import registry
from tests.test_queries import FOLDER, table


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, want.fetchall())
