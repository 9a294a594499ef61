"""Every query with an oracle against DuckDB, and every other one for a stable, non-empty result."""

from __future__ import annotations

import duckdb
import pytest
from brevia.plans import registry

TABLES = "events documents conversations pages benchmark labels embeddings"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(rows):
    return sorted((tuple((k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.items())) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    found = plain(r.asDict() for r in registry.QUERIES[name](spark, sf_dir).collect())
    want = duck.sql(registry.ORACLES[name])
    assert found == plain(dict(zip(want.columns, r, strict=True)) for r in want.limit(10**8).fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_is_stable(spark, sf_dir, name):
    once, again = (plain(r.asDict(True) for r in registry.QUERIES[name](spark, sf_dir).collect()) for _ in range(2))
    assert once and once == again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4 and entry.queries().keys() >= entry.oracle_sql().keys()
