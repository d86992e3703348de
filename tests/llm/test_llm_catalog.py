import os

import duckdb
import pytest

import __spark_entry__ as entry
from wildloom.llm import catalog

SMALL = "/root/testdata/sf0.001"
# The columns the queries must have.
COLUMNS = {"p3_found": ["id", "kind"], "p4_found": ["id"], "p7_found": ["id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "grade"]}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in catalog.SQL:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
        res = con.execute(catalog.SQL[name])
        order = [x[0] for x in res.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(order).collect()))) == sorted(map(repr, res.fetchall()))
        return
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()
