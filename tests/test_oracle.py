"""Every query that has SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from sitelens.plans import file_queries, panel_queries, record_queries, registry, space_queries, study_queries, table_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.10g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
