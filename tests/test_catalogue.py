"""Every registered query runs; where SQL expresses it, both agree row by row."""

import glob
import math
import os

import duckdb
import pytest

from longwave.plans import catalogue


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    found = catalogue.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows or name == "sbic"  # too few samples here; tests/test_chunks.py has what it finds
        return
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows == expected
