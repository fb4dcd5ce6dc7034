"""Every registered query beside its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from mapweave.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (str, bool)) else int(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = tables.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
