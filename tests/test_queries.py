"""Every query with SQL gives what DuckDB gives on the base tables."""

import math

import duckdb
import pytest

from xylem import schema_queries  # noqa: F401  adds its own
from xylem.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    shown = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(map(shown, r)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, base, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    if name in ORACLE_SQL:
        assert rows == plain(base.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    else:
        assert rows
