"""Every catalogue query with SQL gives what DuckDB gives; the others run and give rows."""

from pathlib import Path

import duckdb
import pytest
from helpers import canonical

from barloom import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"  # smaller tables have no whole windows


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = [r.asDict() for r in queries.queries()[name](spark, sf).collect()]
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL) - {"baseline_evaluation"}))
def test_gives_rows(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
