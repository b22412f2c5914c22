"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def text(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_and_types(spark, duck, sf_dir, name):
    if not Path(sf_dir).is_dir():
        pytest.skip("no test tables here")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == {d[0]: str(d[1]) for d in found.description}
    at = [names.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
