"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from meridian.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.Q[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
    kinds = {c[0]: str(c[1]) for c in duck.execute(catalog.SQL[name]).description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    assert {c: same.get(t, t) for c, t in got.dtypes} == {c: t for c, t in kinds.items()}
