"""Every registered catalog query against its SQL counterpart in DuckDB."""

import duckdb
import pytest

from tagloom.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    except TypeError:
        return str(v)


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    done = con.execute(registry.oracle_sql()[name])
    want = rows([d[0] for d in done.description], done.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
