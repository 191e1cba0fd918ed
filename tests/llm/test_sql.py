"""Every training-data query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weftwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
