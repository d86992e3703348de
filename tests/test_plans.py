"""Plans: only needed columns are read, nothing is multiplied out, constant patterns reach the scan."""

import pytest
from pyspark.sql import functions as F

from wildloom import catalog
from wildloom.functions import any_like
from wildloom.operators.wildcard import wildcard_join
from wildloom.session import table

SMALL = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,unread", [("p6_found", "text"), ("p6_report", "title"), ("wildcard_join_agg", "text"), ("engagement_share", "url"), ("wildcard_anti", "text"), ("like_prefix", "text")])
def test_columns_are_pruned(spark, name, unread):
    p = plan(catalog.QUERIES[name](spark, SMALL))
    assert "ReadSchema" in p and f"{unread}:string" not in p.replace("ReadSchema: struct<title:string>", "")


@pytest.mark.parametrize("name", ["p2_found", "p6_found", "wildcard_join_pairs", "wildcard_join_ngram", "wildcard_semi", "thread_coherence", "topics_without_blocked", "first_match_p064"])
def test_nothing_is_multiplied_out(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SMALL))


def test_parsing_needs_no_python_and_no_shuffle(spark):
    p = plan(catalog.QUERIES["p2_loaded"](spark, SMALL))
    assert "Python" not in p and "Arrow" not in p and "Exchange" not in p


def test_filters_are_pushed(spark):
    p = plan(table(spark, SMALL, "hackernews").where(any_like(F.col("title"), ["Notes from%"])).select("id"))
    assert "StringStartsWith(title,Notes from)" in p


def test_few_patterns_stay_in_the_jvm(spark):
    pats = spark.createDataFrame([("%spell%",), ("%a_b%",)], "p string")
    p = plan(wildcard_join(table(spark, SMALL, "hackernews").select("id", "title"), pats, "title", "p"))
    assert "BroadcastNestedLoopJoin" in p and "ArrowEvalPython" not in p
