import random

import pytest
from oracle import matches
from pyspark.sql import functions as F

from wildloom.functions import any_like, first_case, like, literal_positions
from wildloom.plans.patterns import fold_wildcards, prepare_patterns, segments, skeleton, spark_like, spark_like_column

# text, pattern, escape, expected
CASES = [
    ("abc", "abc", None, True), ("abc", "b", None, False), ("abc", "%b%", None, True), ("abc", "a%%c", None, True),
    ("", "", None, True), ("", "%", None, True), ("", "_", None, False), ("a", "", None, False),
    ("ab", "__", None, True), ("ab", "_", None, False), ("ab", "___", None, False), ("ab", "_%_", None, True), ("a", "_%_", None, False),
    ("mississippi", "m%iss%ip%i", None, True), ("mississippi", "%iss%iss%iss%", None, False), ("aaa", "%aa", None, True),
    ("a\nb", "a_b", None, True), ("a\nb\nc", "a%c", None, True), ("😀", "_", None, True), ("😀😀", "_", None, False), ("日本語", "日_語", None, True),
    ("Straße", "Stra_e", None, True), ("é", "_", None, True), ("é", "_", None, False), ("ABC", "abc", None, False),
    ("a\\b", "a\\b", None, True), ("a%b", "a\\%b", None, False), ("a\\xb", "a\\%b", None, True), ("a\0b", "a_b", None, True),
    ("%a_b", "!%a!_b", "!", True), ("xa_b", "!%a!_b", "!", False), ("a", "!a", "!", True), ("!x", "!!%", "!", True), ("x", "!!%", "!", False),
    ("!%", "!!!%", "!", True), ("50%", "%!%", "!", True), ("a\\b", "a!\\b", "!", True), ("a.c", "a.c", None, True), ("abc", "a.c", None, False), ("a[b]", "a[b]", None, True),
]


def test_oracle_agrees_with_cases():
    for text, pattern, escape, want in CASES:
        assert matches(text, pattern, escape) is want, (text, pattern)


@pytest.mark.parametrize("escape", [None, "!"])
def test_cases(spark, escape):
    rows = [(t, p, w) for t, p, e, w in CASES if e == escape]
    df = spark.createDataFrame(rows, "t string, p string, want boolean")
    got = df.withColumn("l", spark_like_column(F.col("p"), escape)).select("t", "p", "want", F.expr("t LIKE l").alias("got")).collect()
    assert [(r.t, r.p) for r in got if r.got != r.want] == []
    for t, p, w in rows:
        assert spark.createDataFrame([(t,)], "t string").select(like(F.col("t"), p, escape)).first()[0] is w, (t, p)


@pytest.mark.parametrize("escape", [None, "!", "\\"])
def test_random_pairs(spark, escape):
    rng = random.Random(5)
    rows = []
    for alphabet in ("ab%_", "ab!%_\\", "日x%_!", "é😀\n%_", "a b%"):
        for _ in range(250):
            p = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 8)))
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 10)))
            try:
                rows.append((t, p, spark_like(p, escape), matches(t, p, escape)))
            except ValueError:
                continue
    df = spark.createDataFrame(rows, "t string, p string, l string, want boolean")
    facts = prepare_patterns(df, "p", escape).where("like_pattern <> l").count()
    assert facts == 0
    assert df.where("(t LIKE l) <> want").count() == 0


def test_trailing_escape_raises(spark):
    with pytest.raises(ValueError):
        spark_like("a!", "!")
    with pytest.raises(ValueError):
        spark_like("a", "!!")
    with pytest.raises(Exception, match="escape"):
        spark.createDataFrame([("a!",)], "p string").select(spark_like_column(F.col("p"), "!")).collect()


def test_pattern_facts(spark):
    rows = [("%ab%c_%",), ("abc",), ("__%",), ("",), (None,), ("%a\\b%",)]
    got = {r.p: r for r in prepare_patterns(spark.createDataFrame(rows, "p string"), "p").collect()}
    assert (got["%ab%c_%"].like_kind, got["%ab%c_%"].like_anchor, got["%ab%c_%"].like_literals, got["%ab%c_%"].like_min_len) == ("literal", "ab", 2, 4)
    assert got["abc"].like_kind == got[""].like_kind == "exact"
    assert (got["__%"].like_kind, got["__%"].like_underscores) == ("length", 2)
    assert got[None].like_kind is None and got[None].like_literals is None
    assert got["%a\\b%"].like_anchor == "a\\b"


def test_constant_lists_nulls_and_order(spark):
    df = spark.createDataFrame([("red ring",), ("blue bolt",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(any_like(F.col("t"), ["%ring", "b%"])).collect()] == [True, True, None, False]
    assert [r[0] for r in df.select(any_like(F.col("t"), [])).collect()] == [False] * 4
    labels = df.select(first_case(F.col("t"), [("%r%", "first"), (["%ring", "%o%"], "second")], "rest")).collect()
    assert [r[0] for r in labels] == ["first", "second", "rest", "rest"]
    assert df.select(like(F.col("t"), "RED%", ignore_case=True)).first()[0]


def test_literal_positions(spark):
    df = spark.createDataFrame([("aaa",), ("日本日",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(literal_positions(F.col("t"), "aa")).collect()] == [[1, 2], [], [], None]
    assert df.select(literal_positions(F.col("t"), "日")).collect()[1][0] == [1, 3]
    with pytest.raises(ValueError):
        literal_positions(F.col("t"), "")


def test_constant_patterns_become_string_searches(spark):
    plan = spark.createDataFrame([("a",)], "t string").where(like(F.col("t"), "%abc%"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "LIKE" not in plan


def test_segments_and_skeleton(spark):
    rows = [("%ab__c%_d",), ("a\\%b%c",), ("",), ("%",), ("a",), ("a%%b%",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = {r.p: r for r in df.select("p", segments(F.col("p")).alias("s"), skeleton(F.col("p")).alias("k")).collect()}
    assert got["%ab__c%_d"].s == ["", "ab__c", "_d"]
    assert [(k.literals, k.gaps) for k in got["%ab__c%_d"].k] == [([], [0]), (["ab", "c"], [0, 2, 0]), (["d"], [1, 0])]
    assert got["a\\%b%c"].s == ["a\\%b", "c"] and got["a\\%b%c"].k[0].literals == ["a%b"]
    assert got[""].s == [""] and got["%"].s == ["", ""] and got["a"].s == ["a"] and got["a%%b%"].s == ["a", "b", ""] and got[None].s is None


def test_folded_patterns_match_the_same(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        p = "".join(rng.choice("ab%_%_") for _ in range(rng.randrange(9)))
        rows.append((p, "".join(rng.choice("ab") for _ in range(rng.randrange(7)))))
    df = spark.createDataFrame(rows, "p string, t string").withColumn("f", fold_wildcards(F.col("p")))
    assert df.where("(t LIKE p) <> (t LIKE f)").count() == 0
    assert df.where("f LIKE '%\\%\\_%' OR f LIKE '%\\%\\%%'").count() == 0
