"""Every registered query against its DuckDB SQL, and those without SQL by their rows."""

import datetime
import math

import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLE, QUERIES

from .oracle import rows_of_sql

D = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE:
        names, want = rows_of_sql(D, ORACLE[name])
        assert sorted(names) == sorted(df.columns)
        at = [df.columns.index(n) for n in names]
        key = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
        assert key([tuple(r[i] for i in at) for r in got]) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
