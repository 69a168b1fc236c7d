"""Every registered query of the reference operators runs on the smallest tables and agrees with its SQL twin."""

import os

import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(records, columns):
    say = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(say(r[c]) for c in columns) for r in records)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(got, sorted(names)) == rows([dict(zip(names, r)) for r in cur.fetchall()], sorted(names))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
