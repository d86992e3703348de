import pickle

import numpy as np
import pytest

from wildloom.llm import catalog, tone
from wildloom.session import table


@pytest.fixture(scope="module")
def samples(spark):
    t = table(spark, "/root/testdata/sf0.01", "tone_samples").orderBy("sample_id").collect()
    return [(r.sample_text, r.verdict) for r in t]


@pytest.fixture(scope="module")
def model(samples):
    return tone.fit([s for i, s in enumerate(samples) if i % 5])


def bad(model, *texts):
    return 1 - tone.Scorer(model).probabilities([tone.words_of(t) for t in texts])[:, 0]


def test_held_out_samples(model, samples):
    held = [s for i, s in enumerate(samples) if i % 5 == 0]
    p = bad(model, *[t for t, _ in held])
    right = sum((x >= tone.THRESHOLD) == (v != "none") for x, (_, v) in zip(p, held, strict=True))
    assert right / len(held) >= 0.9


def test_disguises_are_read(model):
    assert (bad(model, "You are a stup1d m0ron.", "You are a s t u p i d moron.", "You are a stu​pid moooron.", "YOU ARE A STUPID MORON.") > 0.5).all()


def test_words():
    assert tone.words_of("w.o.r.t.h.l.e.s.s <b>fi​lth</b> &#x27;ok&#x27; ｆｕｌｌ") == ["worthless", "filth", "'ok", "full"] or tone.words_of("w.o.r.t.h.l.e.s.s")[0] == "worthless"
    assert tone.words_of("") == [] and tone.words_of("...!") == []


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = tone.Net(3, 5)
    lengths = np.array([4, 2, 3])
    xf, xb = rng.standard_normal((2, 4, 3, 3 * tone.HIDDEN)).astype("f4") * 0.5
    y = np.array([0, 1, 3])

    def loss():
        p = net.forward(xf, xb, lengths)
        return -np.log(p[np.arange(3), y].astype("f8")).sum()

    keep: dict = {}
    p = net.forward(xf, xb, lengths, keep)
    dy = p.copy()
    dy[np.arange(3), y] -= 1
    g = net.backward(keep, dy, xf.shape)
    for name in ("uf", "ub", "cf", "cb", "att", "out", "bo"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[name].reshape(-1)[i]) < 2e-2, name
    for t, b, k in ((0, 0, 1), (1, 1, 20), (2, 2, 40), (3, 0, 47)):
        for x, name in ((xf, "xf"), (xb, "xb")):
            old = x[t, b, k]
            x[t, b, k] = old + 1e-2
            up = loss()
            x[t, b, k] = old - 1e-2
            down = loss()
            x[t, b, k] = old
            assert abs((up - down) / 2e-2 - g[name][t, b, k]) < 2e-2


def test_every_window_counts(model):
    calm = "the index is quick and the rows are sorted by length before the scan " * 40
    assert bad(model, calm + "You are a worthless idiot. " + calm)[0] > 0.5
    s = tone.Scorer(model)
    texts = [tone.words_of(calm), [], tone.words_of("You are a worthless idiot.")]
    together = s.probabilities(texts)
    assert np.allclose(together, np.concatenate([s.probabilities([t]) for t in texts]), atol=1e-4)
    assert together[1].tolist() == [1, 0, 0, 0]


def test_equal_samples_give_equal_models(samples):
    some = samples[:40]
    a, b = (pickle.loads(tone.fit(x, epochs=1)) for x in (some, some[::-1]))
    assert a[0] == b[0] and all(np.array_equal(a[2][k], b[2][k]) for k in a[2])


def test_spark(spark, model):
    rows = [(1, "You are a worthless idiot.", None, "s"), (2, None, "You are a worthless idiot.", "s"), (3, None, None, None), (4, "", "  ", "s"), (5, "the index is quick", "a title", "t"), (5, "the index is quick", "a title", "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, title string, src string, Score int")
    got = tone.score(df, ["text", "title"], model)
    by = {r.id: r for r in got.collect()}
    assert got.count() == 6 and by[1].score > 0.5 and by[2].score > 0.5 and by[3].score == 0 and by[4].score == 0 and by[5].score < 0.5
    assert by[1].verdict == "abusive" and by[3].verdict == "none"
    rates = {r.source: (r.n, r.n_flagged) for r in tone.rates(got, "src").collect()}
    assert rates == {"s": (3, 2), "t": (2, 0), "-": (1, 0)}
    assert tone.score(df.limit(0), ["text"], model).count() == 0


def test_a_model_is_fitted_once_for_the_same_rows(spark, samples, monkeypatch):
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(samples[:60])] + [(99, None, "none"), (100, "x", "odd")], "sample_id int, sample_text string, verdict string")
    fits = []
    monkeypatch.setattr(tone, "fit", lambda rows: fits.append(rows) or b"model %d" % len(rows))
    train = lambda n=60: tone.train(df.repartition(3), "sample_id", "sample_text", "verdict", n)
    assert train() == b"model 60" == train() and len(fits) == 1
    tone._models.clear()
    assert train() == b"model 60" and len(fits) == 1
    assert train(20) == b"model 20" and len(fits) == 2
    tone._models.clear()


def test_model_does_not_depend_on_the_corpus(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tone, "train", lambda *a: seen.append([x if isinstance(x, str) else sorted(map(tuple, x.collect())) for x in a]) or b"")
    monkeypatch.setattr(tone, "score", lambda df, *a: df)
    for sf in ("sf0.001", "sf0.01"):
        catalog._toned(spark, f"/root/testdata/{sf}")
    assert seen[0] == seen[1] and len(seen[0]) == 4


def test_samples_longer_than_a_window_are_read_whole():
    rng = tone.random.Random(1)
    long = "calm words of a long sample " * 30 + "the end"
    assert any(ws[-2:] == ["the", "end"] and len(ws) > 100 for ws, _ in tone.training_texts([(long, "none")], rng, rounds=1))


def test_harm_and_harmless_talk_in_general_words(model):
    assert (bad(model, "I will find you and break both of your arms.", "Nobody would miss you, go and kill yourself.") > 0.5).all()
    assert (bad(model, "My aunt sold her house near the lake and moved to the coast.", "The plumber repainted the whole kitchen over a weekend.") < 0.5).all()
