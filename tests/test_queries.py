"""Every query with SQL gives the same rows as DuckDB; those without run."""

import duckdb
import pytest

from trackloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 7) + 0.0) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(catalog.oracle_sql()[name])
    names, kinds = [d[0] for d in out.description], {d[0]: str(d[1]) for d in out.description}
    assert sorted(names) == columns
    want = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want and want
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0
