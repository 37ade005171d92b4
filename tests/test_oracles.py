"""Every driver query against its DuckDB oracle on sf0.001 (sorted rows,
1e-9 relative tolerance), plus the rows-only ones."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from driver_queries import REGISTRY
from tests.conftest import SF001

TABLES = ("part", "orders", "lineitem", "events")
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


def _key(row, order):
    return tuple("" if row[i] is None else (round(row[i], 6) if isinstance(row[i], float) else str(row[i])) for i in order)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = df.collect()
    sqls = E.oracle_sql()
    if name not in sqls:
        assert df.columns
        return
    rel = con.sql(sqls[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    # Column types agree too (Spark simple type -> DuckDB type name).
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    assert spark_types == duck_types
    assert len(rows) == len(orows)
    so = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    oo = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    a = sorted(_key(tuple(r), so) for r in rows)
    b = sorted(_key(r, oo) for r in orows)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-6)
            else:
                assert u == v


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["item1", "item2", "total_util", "avg_uo", "support", "itemset"]
    assert df.count() >= 0
