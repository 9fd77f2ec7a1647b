"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodeseek.queries import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    other = duck.sql(SQL[name])
    names = other.columns
    assert sorted(names) == sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    assert ours == sorted((plain(r) for r in other.fetchall()), key=repr)
