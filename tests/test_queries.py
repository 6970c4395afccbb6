from __future__ import annotations

import math
import os

import duckdb
import pytest

from threadloom import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df, sql = registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name]
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(sql).columns)
    rows = lambda found: sorted(tuple(map(plain, r)) for r in found)
    assert rows(df.select(*cols).collect()) == rows(duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall())
