import random

import pytest
from tokenizers import Tokenizer

from wildloom.llm import tokens

SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "é", "é", "😀", "'s", "'ll", "'", "1", "22", "====", "<|endoftext|>", "ß", "東京", "​", "\x1c", "\x85", "　", " ", "-", "_", "0", "ﷺ", "𝔘"]


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_random_texts(enc, lib):
    rng = random.Random(3)
    for _ in range(4000):
        s = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(16)))
        assert enc.ids(s) == lib(s), repr(s)
        assert enc.decode(enc.ids(s)) == s


@pytest.mark.parametrize("s", ["", " ", "=" * 30_000, "ab" * 10_000, " " * 5000, "word " * 8000, "\n \n" * 700, "é" * 4000])
def test_long_and_plain(enc, lib, s):
    assert enc.ids(s) == lib(s)


def test_prefix_tokens_are_those_of_each_prefix(enc, lib):
    data = b" unbelievably"
    last: list[int] = []
    for end in range(1, len(data) + 1):
        enc.v.extend(data[:end], last)
        assert last[end - 1] == lib(data[:end].decode())[-1]
        assert enc.v.trace(last[:end]) == lib(data[:end].decode())


def test_edits(enc):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(12)))
        e = tokens.EditableText(enc, text)
        for _ in range(6):
            new = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(4)))
            if rng.random() < 0.5:
                e.append(new)
                text += new
            else:
                a = rng.randrange(len(text) + 1)
                b = min(len(text), a + rng.randrange(5))
                e.edit(a, b, new)
                text = text[:a] + new + text[b:]
            assert e.text == text and e.ids() == enc.ids(text)


def test_remembered_pieces_are_bounded(enc, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 10)
    e = tokens.Encoder(tokens.read_vocabulary())
    for i in range(200):
        assert e.ids(f"x{i} y{i}") == enc.ids(f"x{i} y{i}")
    assert len(e.pieces) <= 10


def test_spark(spark, lib):
    rows = [(1, "a b"), (2, ""), (3, None), (3, None), (4, " x\n\n y"), (None, "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), lib(t or "")) for k, t in rows)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []
    n = tokens.count_tokens(df, "text", "N_Tokens").collect()
    assert sorted(r.N_Tokens for r in n) == sorted(len(lib(t or "")) for _, t in rows)
    with pytest.raises(ValueError):
        tokens.encode_corpus(df, "nope", "text")
