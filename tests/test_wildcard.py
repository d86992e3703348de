import random

import pytest
from oracle import matches
from pyspark.sql import functions as F

from wildloom.operators.wildcard import choose, conjunctive_join, first_match, measure, wildcard_join
from wildloom.operators.search import literal_hits
from wildloom.plans.patterns import prepare_patterns
from wildloom.sources import workload

STRATEGIES = ("nested", "automaton", "ngram", "auto")
TEXTS = [(1, "the red ring"), (2, "a blue bolt"), (3, None), (4, ""), (5, "the red ring"), (6, "ring"), (7, "x" * 20_000 + "needle"), (8, "50% off_"), (9, "Ärger RING")]
PATTERNS = [(1, "%ring%"), (2, "ring"), (3, "%"), (4, "____"), (5, None), (6, "%b%b%"), (7, "%ring%"), (8, "%needle"), (9, ""), (10, "%off_%"), (11, "_%e_%"), (12, "%zz%"), (13, "%i%")]


def want(texts=TEXTS, patterns=PATTERNS, fold=False):
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    return sorted((i, j) for i, t in texts for j, p in patterns if t is not None and p is not None and matches(low(t), low(p)))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEXTS, "id int, t string"), spark.createDataFrame(PATTERNS, "pid int, p string")


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("fold", [False, True])
def test_inner(tables, strategy, fold):
    got = wildcard_join(*tables, "t", "p", strategy=strategy, ignore_case=fold).select("id", "pid").collect()
    assert sorted(map(tuple, got)) == want(fold=fold)


@pytest.mark.parametrize("strategy", ("nested", "automaton", "ngram"))
def test_semi_and_anti_keep_null_rows_apart(tables, strategy):
    texts, patterns = tables
    some = patterns.where("pid not in (3, 9)")
    hit = {i for i, _ in want(patterns=[p for p in PATTERNS if p[0] not in (3, 9)])}
    semi = wildcard_join(texts, some, "t", "p", how="semi", strategy=strategy)
    anti = wildcard_join(texts, some, "t", "p", how="anti", strategy=strategy)
    assert {r.id for r in semi.collect()} == hit
    assert {r.id for r in anti.collect()} == {i for i, _ in TEXTS} - hit
    assert semi.columns == texts.columns


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_empty_sides_and_repeats(spark, tables, strategy):
    texts, patterns = tables
    none = patterns.limit(0)
    assert wildcard_join(texts, none, "t", "p", strategy=strategy).count() == 0
    assert wildcard_join(texts.limit(0), patterns, "t", "p", strategy=strategy).count() == 0
    twice = texts.unionByName(texts)
    assert wildcard_join(twice, patterns, "t", "p", strategy=strategy).count() == 2 * len(want())


def test_clashing_names(spark):
    left = spark.createDataFrame([(1, "abc", "x")], "id int, t string, p string")
    right = spark.createDataFrame([(7, "a%", 5)], "id int, p string, t int")
    got = wildcard_join(left, right, "t", "p")
    assert got.columns == ["id", "t", "p", "pattern_id", "pattern_p", "pattern_t"]
    assert got.first().pattern_id == 7
    with pytest.raises(ValueError):
        wildcard_join(left, right, "nope", "p")


@pytest.mark.parametrize("strategy", ("nested", "automaton", "ngram"))
def test_first_match(spark, tables, strategy):
    texts, _ = tables
    pats = spark.createDataFrame([(2, "%ring%", "ring"), (1, "%red%", "b"), (1, "%the%", "a"), (3, None, "never"), (9, "____", "four")], "prio int, p string, label string")
    got = {r.id: r.first_label for r in first_match(texts, pats, "t", "p", "prio", "label", strategy=strategy).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None, 5: "a", 6: "ring", 7: None, 8: None, 9: None}


def test_escape_and_malformed(spark):
    t = spark.createDataFrame([(1, "50%"), (2, "50x"), (3, "a_b")], "id int, t string")
    p = spark.createDataFrame([(1, "%!%"), (2, "a!_b")], "pid int, p string")
    assert sorted((r.id, r.pid) for r in wildcard_join(t, p, "t", "p", escape="!").collect()) == [(1, 1), (3, 2)]
    bad = spark.createDataFrame([(1, "a!")], "pid int, p string")
    with pytest.raises(Exception, match="escape"):
        wildcard_join(t, bad, "t", "p", escape="!").collect()


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))) for i in range(300)]
    patterns = [(i, "".join(rng.choice("abc%_") for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    t, p = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(patterns, "pid int, p string")
    answer = want(texts, patterns)
    for n in (1, 4, 17):
        for s in ("automaton", "ngram", "nested"):
            got = wildcard_join(t.repartition(n), p.repartition(n), "t", "p", strategy=s).select("id", "pid").collect()
            assert sorted(map(tuple, got)) == answer


@pytest.mark.parametrize("name", ["sweep_M=10", "wildcards_M=100", "sweep_M=1k", "long_text_M=1k"])
def test_synthetic_workloads_give_the_published_digests(spark, name):
    # Pairs, digest of the corpus, digest of the pairs.
    known = {
        "sweep_M=10": (9213, "6b08affa22462454", "065a444030c26a78"),
        "wildcards_M=100": (5866, "2f5f992a5ca0f0dd", "d8b61f584999a0fe"),
        "sweep_M=1k": (9895, "a117be33187c24e7", "a0efb1adc73d104f"),
        "long_text_M=1k": (1719, "facf65c6cf27d2f4", "78be4e47d20db721"),
    }[name]
    texts, patterns = workload.generate(workload.SPECS[name])
    assert workload.corpus_digest(texts, patterns) == known[1]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pid long, p string")
    pairs = [tuple(r) for r in wildcard_join(t, p, "t", "p").select("id", "pid").collect()]
    assert (len(pairs), workload.pairs_digest(pairs)) == (known[0], known[2])


def test_chooser(spark):
    few = prepare_patterns(spark.createDataFrame([("%a%",)], "p string"), "p")
    many = prepare_patterns(spark.range(500).select(F.concat(F.lit("%a"), F.col("id").cast("string"), F.lit("%")).alias("p")), "p")
    assert choose(measure(few)) == "nested" and choose(measure(many)) == "automaton"


@pytest.mark.parametrize("many", [False, True])
def test_two_texts_one_pattern(spark, many):
    rng = random.Random(6)
    text = lambda: rng.choice([None, "", "ab", "ba", "aab", "".join(rng.choice("ab") for _ in range(rng.randrange(8)))])
    rows = [(i, text(), text()) for i in range(150)]
    pats = [(i, "".join(rng.choice("ab%_") for _ in range(rng.randrange(1, 5)))) for i in range(70 if many else 20)] + [(900, None), (901, "ab"), (902, "%"), (903, "")]
    df, p = spark.createDataFrame(rows, "id int, x string, y string"), spark.createDataFrame(pats, "id int, p string")
    got = conjunctive_join(df, ("x", "y"), p, "p").select("id", "pattern_id").collect()
    answer = [(i, j) for i, x, y in rows for j, q in pats if None not in (x, y, q) and matches(x, q) and matches(y, q)]
    assert sorted(map(tuple, got)) == sorted(answer)


@pytest.mark.parametrize("words", [["aa"], ["aa", "a", "ab", "日", "aab", "b a"], []])
def test_literal_hits(spark, words):
    texts = ["aaab aab", "", None, "日本日", "b a", "x" * 9000 + "aab"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "id int, t string, Position int")
    lits = spark.createDataFrame([(w,) for w in words + words[:1]] + [("",), (None,)], "l string")
    got = literal_hits(df, "t", lits, "l")
    assert sorted(x.lower() for x in got.columns) == ["id", "literal", "position", "t"]
    want = sorted((i, w, p + 1) for i, t in enumerate(texts) if t for w in words for p in range(len(t)) if t.startswith(w, p))
    assert sorted((r["id"], r["literal"], r["position"]) for r in got.collect()) == want
    assert literal_hits(df.limit(0), "t", lits, "l").count() == 0
    joined = literal_hits(df, "t", lits, "l", max_broadcast=-1)
    assert sorted((r["id"], r["literal"], r["position"]) for r in joined.collect()) == want


def test_large_first_match_is_no_error(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the red ring"), (2, None), (2, "a blue bolt"), (3, "a blue bolt"), (4, "")], "id int, t string")
    pats = spark.createDataFrame([(i, f"%w{i}%", f"n{i}") for i in range(60)] + [(7, "%bolt", "bolt"), (9, "%blue%", "blue"), (80, "", "empty")], "prio int, p string, label string")
    answer = [(1, None), (2, None), (2, "bolt"), (3, "bolt"), (4, "empty")]
    for limit in (10_000_000, 10):
        monkeypatch.setattr("wildloom.operators.wildcard.MAX_BROADCAST", limit)
        got = first_match(texts, pats, "t", "p", "prio", "label").select("id", "first_label").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(answer, key=repr)


def test_a_worker_keeps_no_state_between_texts(spark):
    """One search serves texts in any order, alone or together, with the same answer for each."""
    rng = random.Random(9)
    patterns = [(i, "".join(rng.choice("ab%_") for _ in range(rng.randrange(1, 8)))) for i in range(200)]
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(150)]
    p = spark.createDataFrame(patterns, "pid int, p string")
    t = spark.createDataFrame(texts + texts[::-1], "id int, t string")
    got = sorted(map(tuple, wildcard_join(t.repartition(3), p, "t", "p", strategy="automaton").select("id", "pid").collect()))
    assert got == sorted(want(texts, patterns) * 2)


def test_private_signs_in_patterns(spark):
    t = spark.createDataFrame([(1, "a\ue000b"), (2, "ab"), (3, "a\ue001b"), (4, "\ue000%"), (5, "a\ue001\ue002b")], "id int, t string")
    p = spark.createDataFrame([(1, "a\ue000b"), (2, "a!\ue001b"), (3, "\ue000!%"), (4, "%\ue001\ue002%")], "pid int, p string")
    got = wildcard_join(t, p, "t", "p", escape="!").select("id", "pid").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 2), (4, 3), (5, 4)]
