"""Every query against its SQL, run by another engine over the same files."""

import math
from pathlib import Path

import duckdb
import pytest

import fathomline.plans  # noqa: F401  (fills the registry)
from fathomline.plans.registry import ORACLE_SQL, QUERIES


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in found), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cursor = db.execute(ORACLE_SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == pytest.approx(y, abs=1e-6) if isinstance(x, float) and isinstance(y, (float, int)) else x == y for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
