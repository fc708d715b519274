"""Every registered query with an oracle gives DuckDB's rows; the others run."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import event_queries, exact_queries, operator_queries, process_queries, registry, text_queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(rows):
    return sorted(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]
    r = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert rows_of(got) == rows_of(dict(zip(columns, x, strict=True)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if "exact" in df.columns:
        assert all(r.exact for r in rows)


def test_entry_without_corpus_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
