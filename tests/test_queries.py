"""Every registered query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from siltstone.plans.catalogue import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return round(value, 6)
    return [tidy(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name].run(spark, sf_dir)
    rows = found.collect()
    if not QUERIES[name].sql:
        assert rows
        return
    cursor = duck.execute(QUERIES[name].sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(str(tidy([r[c] for c in columns])) for r in rows) == sorted(str(tidy(r)) for r in cursor.fetchall())


def test_names_are_unique_and_entry_runs(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
