import numpy as np
import pytest

from wildloom.llm import reading
from wildloom.session import table

SMALL = "/root/testdata/sf0.01"


def test_english():
    en = reading.words_of("The site is quick and it was new, but the list of the words is not in it.")
    assert reading.is_english(en)
    assert not reading.is_english(reading.words_of("Das ist nicht der Index, und die Liste wird mit der Zeit langsam."))
    assert not reading.is_english(reading.words_of("Le filtre est trop lent et la liste ne doit pas être dans le cache."))
    assert not reading.is_english([]) and not reading.is_english(["zzz"] * 50)


def brute(docs, examples, rounds):
    """Shares of documents by dictionaries; docs are word lists, examples (word list, grade)."""
    n = len(docs)
    rarity = {w: np.log((n + 1) / sum(w in d for d in docs)) for d in docs for w in d}
    mass = sum(rarity[w] for d in docs for w in d)
    raw = {g: {w: sum(e.count(w) for e, x in examples if x == g) * rarity[w] for w in rarity} for g in reading.GRADES}
    have = [g for g in raw if sum(raw[g].values())]
    base = {w: np.array([raw[g][w] * reading.CLAMP / (1 - reading.CLAMP) * mass / len(have) / sum(raw[g].values()) if g in have else 0.0 for g in raw]) for w in rarity}
    value = {w: b / b.sum() if b.sum() else b for w, b in base.items()}

    def of(d):
        known = [w for w in d if value[w].sum()]
        total = sum(rarity[w] for w in known)
        return sum((rarity[w] * value[w] for w in known), np.zeros(4)) / total if total else np.zeros(4)

    for _ in range(rounds):
        now = [of(d) for d in docs]
        new = {}
        for w in rarity:
            live = [(d.count(w) * rarity[w], v) for d, v in zip(docs, now, strict=True) if v.sum() and w in d]
            total = base[w].sum() + sum(x for x, _ in live)
            new[w] = (base[w] + sum((x * v for x, v in live), np.zeros(4))) / total if total else np.zeros(4)
        value = new
    return [of(d) for d in docs]


@pytest.mark.parametrize("limit", [reading.MAX_BROADCAST, 0])
def test_iterations_against_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    vocabulary = ["the", "of", "is", "and"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [[vocabulary[j] for j in rng.integers(0, len(vocabulary), n)] + ["the", "of", "is"] for n in (5, 1, 9, 30, 12, 12, 7)]
    examples = [([vocabulary[j] for j in rng.integers(4, 12, 6)], g) for g in (1, 2, 4, 4)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string")
    coded = reading.encode_words(df, "id", "text")
    for rounds in (0, 1, 3):
        v = reading.Values(coded, [(" ".join(e), g) for e, g in examples], 0.0, rounds, limit)
        got = {r.key: (r.s1, r.s2, r.s3, r.s4) for r in v.documents().collect()}
        assert v.small == (limit > 0) and np.allclose([got[i] for i in range(len(docs))], brute(docs, examples, rounds))


def test_grades_reach_documents_without_an_example_word(spark):
    """Documents of two chains share words only with their neighbours; without iterations nothing reaches their far ends."""
    glue = "the of and is it was"
    rows = []
    for chain in "xy":
        for k in range(6):
            rows.append((len(rows), f"{chain}{'abcdefgh'[k]} {chain}{'abcdefgh'[k + 1]} " * 6 + glue))
    df = spark.createDataFrame(rows, "id int, text string")
    examples = spark.createDataFrame([("xa xa xa", 1), ("ya ya ya", 4)], "t string, grade int")
    want = {i: 1 if i < 6 else 4 for i in range(12)}
    ran = {r.id: r.grade for r in reading.reading_levels(df, "id", "text", examples, "t", "grade").collect()}
    none = {r.id: r.grade for r in reading.reading_levels(df, "id", "text", examples, "t", "grade", iterations=0).collect()}
    assert sum(ran[i] == want[i] for i in want) >= 11
    assert sum(none[i] == want[i] for i in want) == 2 and sum(none[i] is None for i in want) == 10


def test_iterations_end_when_nothing_moves(spark):
    d = table(spark, SMALL, "documents").limit(200)
    ex = [(r.sample_text, r.grade) for r in table(spark, SMALL, "grade_samples").collect()]
    coded = reading.encode_words(d, "doc_id", "text")
    v = reading.Values(coded, ex)
    assert v.residual <= reading.TOLERANCE and 1 < v.rounds < reading.MOST_ITERATIONS
    more = {r.key: r for r in reading.Values(coded, ex, 0.0, v.rounds + 30).documents().collect()}
    assert all(abs(r.s1 - more[r.key].s1) < 0.02 for r in v.documents().collect())


def test_held_out_examples(spark):
    rows = table(spark, SMALL, "grade_samples").orderBy("sample_id").collect()
    train = spark.createDataFrame([(r.sample_text, r.grade) for i, r in enumerate(rows) if i // 4 % 4], "t string, grade int")
    held = [(i, r.sample_text, r.grade) for i, r in enumerate(rows) if i // 4 % 4 == 0]
    docs = table(spark, SMALL, "documents").selectExpr("doc_id + 1000 AS id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in held], "id long, text string"))
    got = {r.id: r for r in reading.reading_levels(docs, "id", "text", train, "t", "grade").where("id < 1000").collect()}
    assert sum(got[i].grade == g for i, _, g in held) / len(held) >= 0.9
    assert all(1 <= got[i].difficulty <= 4 for i, _, _ in held)


def test_edges(spark):
    examples = spark.createDataFrame([("the cat is on the mat and it is red", 1), ("notwithstanding the ostensible generality of the conjecture", 4), (None, 2), ("x", None)], "t string, grade int")
    text = "the cat is on the mat and it is red. "
    rows = [(1, text * 3), (2, None), (3, ""), (4, "  "), (5, "Das ist nicht der Index und die Liste."), (6, text * 3000), (1, text * 3), (7, "the zzq of the qqx and the vvw in the ppk")]
    df = spark.createDataFrame([(*r, 9, "w") for r in rows], "doc_id long, text string, grade int, words string")
    got = reading.reading_levels(df, "doc_id", "text", examples, "t", "grade").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].grade == 1 and by[6].grade == 1 and by[6].n_words == 30000
    assert all(by[i].grade is None and not by[i].english for i in (2, 3, 4, 5)) and by[2].n_words == 0
    none = spark.createDataFrame([], "t string, grade int")
    assert all(r.grade is None for r in reading.reading_levels(df, "doc_id", "text", none, "t", "grade").collect())
    assert reading.reading_levels(df.limit(0), "doc_id", "text", examples, "t", "grade").count() == 0
    with pytest.raises(ValueError):
        reading.reading_levels(df, "nope", "text", examples, "t", "grade")
