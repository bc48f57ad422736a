"""Every registered query of the library that has SQL, against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

duckdb = pytest.importorskip("duckdb")
from reciprospark.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(value):
    value = float(value) if isinstance(value, Decimal) else value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


#: Queries that give no row on the smallest tables.
EMPTY = {"polar_filter"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, row))) for row in rel.fetchall()), key=str)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    assert len(rows) == len(want) and (rows or name in EMPTY)
    different = [(a, b) for a, b in zip(rows, want) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x)) for x, y in zip(a, b))]
    assert not different, different[:3]
