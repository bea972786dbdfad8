"""Every registered query of the engine against its SQL counterpart, on the smallest tables."""

import duckdb
import pytest

from stratadoc.plans.oracles import ORACLES
from stratadoc.plans.queries import QUERIES
from stratadoc.session import TABLES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return repr(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == columns
    expected = sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == expected
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
    spark.catalog.clearCache()


def test_entry_names_and_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "i", "score"]
