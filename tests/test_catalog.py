"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from wildloom import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows(names, values):
    order = sorted(names)
    text = [repr(tuple(r[names.index(n)] for n in order)) for r in values]
    return order, sorted(re.sub(r"(\d+\.\d{6})\d+", r"\1", t) for t in text)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.SQL:
        res = duck.execute(catalog.SQL[name])
        assert got == rows([x[0] for x in res.description], res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
