import pytest

from wildloom.llm import pii

KEY = b"test key"


def kinds(text):
    return [(k, f) for _, _, k, f in pii.find_spans(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail ann.b+c@site.example.org now", [("email", "ann.b+c@site.example.org")]),
        ("x (at) host [dot] example", [("email", "x (at) host [dot] example")]),
        ("write jo7 at host dot mail dot example please", [("email", "jo7 at host dot mail dot example")]),
        ("ann＠site.example", [("email", "ann@site.example")]),
        ("ann&#64;site.example", [("email", "ann@site.example")]),
        ("call +44 1632 960784 or (212) 555-0170", [("phone", "+44 1632 960784"), ("phone", "(212) 555-0170")]),
        ("five five five, zero one six nine", [("phone", "five five five, zero one six nine")]),
        ("030/23125-620", [("phone", "030/23125-620")]),
        ("my SSN is 987-65-4320.", [("id_number", "987-65-4320")]),
        ("IBAN DE00 1234 5678 9012 3456 00", [("id_number", "DE00 1234 5678 9012 3456 00")]),
        ("passport no. X1234567", [("id_number", "X1234567")]),
        ("at 12 Mill Hill Lane, Oldtown", [("address", "12 Mill Hill Lane")]),
        ("Lindenweg 82, 00085 Ort", [("address", "Lindenweg 82")]),
        ("109 bis, chemin des Moulins", [("address", "109 bis, chemin des Moulins")]),
        ("Calle del Sol, n.º 7", [("address", "Calle del Sol, n.º 7")]),
        ("I met Maria K. Olsen-Berg there", [("name", "Maria K. Olsen-Berg")]),
        ("same Olsen, Maria who", [("name", "Olsen, Maria")]),
        ("MARIA OLSEN CAME", [("name", "MARIA OLSEN")]),
        ("&lt;b>Maria&#32;Olsen's laptop", [("name", "Maria Olsen")]),
    ],
)
def test_finds(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text",
    [
        None, "", "   ", "parser@2.1.0 and @someone", "192.0.2.17 port 5432", "ISBN 978-0-00-000000-2", "ticket 4471-22-9003", "Dial in with code 4471 2290 at 15:00", "Build 20190412-0331 scanned 3,886,492 rows",
        "the Marta index and the Felix parser", "Thanks, Julia", "RIP Irene E.", "Main Street shops", "Meet me at 10:30 in room 14 on the 2nd floor", "we met at the office. com is short", "part 555-A12-0199-K", "SSN column, shown as ***-**-****",
        "Alice sends Bob a key", "a < b and c > d", "it took 40 hours at 12.4.2019 prices", "x" * 50_000, "1 " * 20_000,
    ],
)
def test_look_alikes(text):
    assert kinds(text) == []


def test_places_are_those_of_the_text():
    text = "a &amp; b — Maria&nbsp;Olsen, ann&#64;site.example​ end"
    spans = pii.find_spans(text)
    assert [text[a:b] for a, b, _, _ in spans] == ["Maria&nbsp;Olsen", "ann&#64;site.example"]


def test_surrogates_keep_form_and_follow_the_key():
    a = pii.surrogate(KEY, "phone", "2125550170", "(212) 555-0170")
    assert a == pii.surrogate(KEY, "phone", "2125550170", "(212) 555-0170") != pii.surrogate(b"other", "phone", "2125550170", "(212) 555-0170")
    assert len(a) == 14 and a[0] == "(" and a[9] == "-"
    assert pii.surrogate(KEY, "name", "maria olsen", "Olsen, Maria").split(", ")[1] in pii.FEMALE
    assert pii.surrogate(KEY, "name", "peter olsen", "PETER OLSEN").isupper()
    assert pii.canonical("email", "X (at) Host [dot] example") == pii.canonical("email", "x@host.example")
    assert pii.canonical("name", "Olsen, Maria") == pii.canonical("name", "Maria K. Olsen")
    assert pii.canonical("phone", "+1 212 555 0170") == pii.canonical("phone", "(212) 555-0170")


def test_anonymize(spark):
    rows = [(1, "Ask Maria Olsen, maria@site.example."), (2, None), (3, ""), (4, "nothing here"), (5, "Olsen, Maria again & maria (at) site.example"), (1, "Ask Maria Olsen, maria@site.example.")]
    df = spark.createDataFrame([(*r, "m", "c") for r in rows], "id int, text string, mentions string, clean_text string")
    got = pii.anonymize(df, "text", KEY).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"id", "text", "mentions", "clean_text"}
    by = {r.id: r.clean_text for r in got}
    assert by[2] is None and by[3] == "" and by[4] == "nothing here"
    mail = by[1].split("[email: ")[1].split("]")[0]
    family, given = by[5].split("[name: ")[1].split("]")[0].split(", ")
    assert f"[name: {given} {family}]" in by[1] and mail.replace("@", " (at) ") in by[5]
    assert "Maria Olsen" not in by[1] and by[1].startswith("Ask [name: ") and " & " in by[5]
    assert pii.anonymize(df.limit(0), "text", KEY).count() == 0


def test_surrogates_are_distinct_and_no_entities(spark):
    # all two-digit numbers are entities, so only longer ones can stand for them
    rows = [("id_number", f"{i:02d}") for i in range(100)] + [("id_number", "07")] * 3 + [("phone", "5550100"), ("name", "ines brork")]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), KEY).collect()
    assert len(got) == 102 == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    assert pii.surrogates(spark.createDataFrame([], "kind string, entity string"), KEY).count() == 0
