"""Abusive, hateful or sexual language: a score for every document.

A bidirectional gated recurrent network with attention pooling reads windows
of words. A word's input is its own vector plus the mean of the vectors of its
character trigrams, so disguised and unknown words have a meaning too. All
weights, vectors included, are trained here with numpy, on labelled samples
and phrases. Every text is scored in all its overlapping windows; its score is
the highest one.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import pickle
import random
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.llm import tone_phrases as P
from wildloom.session import c, columns_or_fail, exists, shared_dir

LABELS = ("none", "abusive", "hateful", "sexual")
WINDOW, STRIDE = 24, 12
DIM, HIDDEN, GRAMS = 24, 16, 4096
#: At most so many labelled rows are read for the fit, by id.
MAX_SAMPLES = 20_000
KEEP = 60_000
#: Windows that are scored together; their states fit into a core's cache.
CHUNK = 512
#: Harmless stretches per round of the training texts.
STRETCHES = 1500
#: Between false alarms and misses on forms that no fitted sample shares.
THRESHOLD = 0.6

# Letters of other scripts that look like Latin ones, and signs used for letters.
_TWINS = str.maketrans("абвгеёзикмнорстухѕіјԁһԛԝαβεηικνορτυχ", "aбbreeзиkmhopctyxsijdhqwabenikvoptux")
_LEET = str.maketrans("0134578@$!|€", "oieastbasile")
_GONE = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|\\[a-z]+\*?\{", re.S)
_SPACED = re.compile(r"(?<![a-z0-9'’])[a-z0-9@$]([ .\-_*·,]{1,2})[a-z0-9@$](?:\1[a-z0-9@$])+(?![a-z0-9'’])")
_WORD = re.compile(r"[a-zà-ÿ0-9@$*'’|!]*[a-zà-ÿ0-9](?:[a-zà-ÿ0-9@$*'’]*[a-zà-ÿ0-9])?")
_LONG = re.compile(r"([a-z])\1{2,}")


def _join(m: re.Match) -> str:
    s = re.sub(r"[ .\-_*·,]", "", m.group())
    return s if len(s) > 3 and not s.isdigit() else m.group()


def words_of(text: str) -> list[str]:
    """Words in lower case; disguises by invisible signs, twins of letters and gaps are undone."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    t = text.lower()
    if not t.isascii():
        t = _GONE.sub("", unicodedata.normalize("NFKC", t)).translate(_TWINS)
    if _SPACED.search(t):
        t = _SPACED.sub(_join, t)
    return _WORD.findall(t)


class Words:
    """Words to rows of inputs; the vocabulary is that of the training texts."""

    def __init__(self, vocabulary: list[str], strong: list[str]):
        self.id = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.strong = strong

    def plain(self, w: str) -> str:
        w = w.strip("'’*!|").replace("’", "'")
        if w.isdigit():
            return "0"
        if w.endswith("'s") and w[:-2]:
            w = w[:-2]
        if w in self.id or w.isascii() and w.isalpha() and not _LONG.search(w):
            return w
        forms = [w]
        if re.search(r"[0-9@$!|]", w) and re.search(r"[a-z]", w):
            forms += [w.translate(_LEET), w.replace("1", "l").translate(_LEET)]
        for f in list(forms):
            if _LONG.search(f):
                forms += [_LONG.sub(r"\1\1", f), _LONG.sub(r"\1", f)]
        for f in forms[1:]:
            if f in self.id:
                return f
        if "*" in w:
            for f in forms:
                p = re.compile("".join("[a-z]" if x == "*" else re.escape(x) for x in f) + r"\Z")
                for s in self.strong:
                    if p.match(s):
                        return s
        return forms[-1]

    def grams(self, w: str) -> list[int]:
        s = f"<{w}>"
        return [zlib.crc32(s[i : i + n].encode()) % GRAMS for n in (3, 4) for i in range(max(1, len(s) - n + 1))]


def _tanh(x: np.ndarray) -> np.ndarray:
    """A rational curve close to tanh; training and scoring use the same one."""
    y = np.clip(x, -3.0, 3.0)
    q = y * y
    return y * (27.0 + q) / (27.0 + 9.0 * q)


def _tanh_slope(x: np.ndarray) -> np.ndarray:
    q = x * x
    return np.where(np.abs(x) < 3.0, (81.0 - 18.0 * q + q * q) / ((9.0 + 3.0 * q) ** 2), 0.0).astype("f4")


def _run(u: np.ndarray, cu: np.ndarray, xs: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction. xs: (T, B, 3H) input parts of update, reset and candidate; mask: (T, B, 1)."""
    steps, n, _ = xs.shape
    h = np.zeros((n, HIDDEN), "f4")
    out = np.empty((steps, n, HIDDEN), "f4")
    for t in range(steps):
        s = h @ u
        pre = 0.5 * (xs[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        gates = 0.5 * _tanh(pre) + 0.5
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        hc = s[:, 2 * HIDDEN :] + cu
        m_pre = xs[t, :, 2 * HIDDEN :] + r * hc
        m = _tanh(m_pre)
        new = m + z * (h - m)
        new = h + mask[t] * (new - h)
        if keep is not None:
            keep.append((h, pre, z, r, hc, m_pre, m))
        h = new
        out[t] = h
    return out


def _bend(x: np.ndarray) -> None:
    """:func:`_tanh` in place."""
    np.clip(x, -3.0, 3.0, out=x)
    q = x * x
    x *= q + 27.0
    q *= 9.0
    q += 27.0
    x /= q


def _states(u: np.ndarray, cu: np.ndarray, xs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """:func:`_run` for scoring alone: nothing is kept, and all is done in place."""
    steps, n, _ = xs.shape
    h = np.zeros((n, HIDDEN), "f4")
    out = np.empty((steps, n, HIDDEN), "f4")
    whole = mask.all((1, 2))
    for t in range(steps):
        s = h @ u
        gates, m = s[:, : 2 * HIDDEN] + xs[t, :, : 2 * HIDDEN], s[:, 2 * HIDDEN :] + cu
        gates *= 0.5
        _bend(gates)
        gates *= 0.5
        gates += 0.5
        m *= gates[:, HIDDEN:]
        m += xs[t, :, 2 * HIDDEN :]
        _bend(m)
        new = h - m
        new *= gates[:, :HIDDEN]
        new += m
        if not whole[t]:
            new -= h
            new *= mask[t]
            new += h
        h = out[t] = new
    return out


def _run_back(u: np.ndarray, xs_shape: tuple, mask: np.ndarray, kept: list, d_out: np.ndarray):
    """Gradients of u, cu and xs of :func:`_run`."""
    du, dcu = np.zeros_like(u), np.zeros(HIDDEN, "f4")
    dxs = np.zeros(xs_shape, "f4")
    dh = np.zeros(d_out.shape[1:], "f4")
    for t in range(xs_shape[0] - 1, -1, -1):
        h, pre, z, r, hc, m_pre, m = kept[t]
        dh = dh + d_out[t]
        d_new = dh * mask[t]
        d_prev = dh * (1 - mask[t]) + d_new * z
        dm = d_new * (1 - z) * _tanh_slope(m_pre)
        dz = d_new * (h - m)
        dr = dm * hc
        d_hc = dm * r
        d_gates = np.concatenate([dz, dr], 1) * 0.25 * _tanh_slope(pre)
        ds = np.concatenate([d_gates, d_hc], 1)
        dxs[t, :, : 2 * HIDDEN] = d_gates
        dxs[t, :, 2 * HIDDEN :] = dm
        du += h.T @ ds
        dcu += d_hc.sum(0)
        dh = d_prev + ds @ u.T
    return du, dcu, dxs


def _turn(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(T, B): for each place the place it has when each sequence is read backwards."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


class Net:
    """The network's weights; ``x`` is the (T, B, DIM) input and ``lengths`` the used steps."""

    def __init__(self, seed: int, n_words: int):
        g = np.random.default_rng(seed)
        k = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        self.p = {
            "word": (g.standard_normal((n_words + 1, DIM)) * 0.1).astype("f4"),
            "gram": (g.standard_normal((GRAMS, DIM)) * 0.3).astype("f4"),
            "wf": k(DIM, 3 * HIDDEN), "uf": k(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, "f4"), "cf": np.zeros(HIDDEN, "f4"),
            "wb": k(DIM, 3 * HIDDEN), "ub": k(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, "f4"), "cb": np.zeros(HIDDEN, "f4"),
            "att": k(2 * HIDDEN, 1), "out": k(2 * HIDDEN, len(LABELS)), "bo": np.zeros(len(LABELS), "f4"),
        }
        self.p["word"][0] = 0

    def forward(self, xf: np.ndarray, xb: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (B, labels). xf and xb: (T, B, 3H), the input parts of both directions, both in reading order."""
        p, steps = self.p, xf.shape[0]
        mask = (np.arange(steps)[:, None] < lengths).astype("f4")[:, :, None]
        turn = _turn(lengths, steps)
        cols = np.arange(xf.shape[1])
        kf, kb = ([], []) if keep is not None else (None, None)
        if keep is None:
            hf = _states(p["uf"], p["cf"], xf, mask)
            hb = _states(p["ub"], p["cb"], xb[turn, cols], mask)[turn, cols]
        else:
            hf = _run(p["uf"], p["cf"], xf, mask, kf)
            hb = _run(p["ub"], p["cb"], xb[turn, cols], mask, kb)[turn, cols]
        h = np.concatenate([hf, hb], 2)
        e = (h @ p["att"])[:, :, 0] + (mask[:, :, 0] - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        y = pooled @ p["out"] + p["bo"]
        y = np.exp(y - y.max(1, keepdims=True))
        y /= y.sum(1, keepdims=True)
        if keep is not None:
            keep.update(mask=mask, turn=turn, cols=cols, kf=kf, kb=kb, h=h, a=a, pooled=pooled)
        return y

    def backward(self, keep: dict, dy: np.ndarray, shape: tuple) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        g["out"], g["bo"] = keep["pooled"].T @ dy, dy.sum(0)
        dpool = dy @ p["out"].T
        h, a = keep["h"], keep["a"]
        da = np.einsum("tbh,bh->tb", h, dpool)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tbh,tb->h", h, de)[:, None].astype("f4")
        dh = a[:, :, None] * dpool + de[:, :, None] * p["att"][:, 0]
        turn, cols = keep["turn"], keep["cols"]
        g["uf"], g["cf"], dxf = _run_back(p["uf"], shape, keep["mask"], keep["kf"], dh[:, :, :HIDDEN])
        g["ub"], g["cb"], dxb = _run_back(p["ub"], shape, keep["mask"], keep["kb"], dh[turn, cols][:, :, HIDDEN:])
        g["xf"], g["xb"] = dxf, dxb[turn, cols]
        return g


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, where places may repeat."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    out[places[first]] += np.add.reduceat(rows[order], first, axis=0)


# --- training ----------------------------------------------------------------------------------------


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x]


def _disguise(w: str, rng: random.Random) -> str:
    """One of the usual disguises of a word."""
    k = rng.randrange(5)
    if k == 0 and len(w) > 3:
        i = rng.randrange(1, len(w) - 1)
        return w[:i] + "*" + w[i + 1 :]
    if k == 1:
        return w.translate(str.maketrans("oieas", "01345"))
    if k == 2:
        return " ".join(w) if len(w) > 3 else w
    if k == 3 and len(w) > 2:
        i = rng.randrange(len(w))
        return w[:i] + w[i] * 4 + w[i + 1 :]
    return w


def _made_up(pieces: list[str], rng: random.Random) -> str:
    """A word that no list holds: the front of one harmless word and the back of another."""
    a, b = rng.choice(pieces), rng.choice(pieces)
    return a[: rng.randrange(1, len(a))] + b[rng.randrange(1, len(b)) :]


def _swapper(rng: random.Random):
    """Puts other words of their kind (insults, groups, occupations and the like) in the place of those of a sample."""
    kinds = (P.INSULTS, P.ADJECTIVES, P.GROUPS, P.SLURS, P.SEXUAL, P.ROLES, P.THINGS)
    kind_of = {w.lower(): ws for ws in kinds for w in ws}
    known = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kind_of), key=len, reverse=True)) + r")\b", re.I)
    return lambda t: known.sub(lambda m: rng.choice(kind_of[m.group().lower()]) if rng.random() < 0.6 else m.group(), t)


def training_texts(samples: list[tuple[str, str]], rng: random.Random, rounds: int = 14) -> list[tuple[list[str], int]]:
    """Word lists with labels: the samples, the filled phrases, and both within other harmless sentences."""
    slots = {"i": P.INSULTS, "a": P.ADJECTIVES, "g": P.GROUPS, "v": P.SLURS, "s": P.SEXUAL, "r": P.ROLES, "t": P.THINGS}
    calm = [s for t, v in samples if v == "none" for s in re.split(r"(?<=[.!?])\s+", t) if s]
    pools = {1: _lines(P.ABUSIVE), 2: _lines(P.HATEFUL), 3: _lines(P.SEXUAL_LINES), 0: _lines(P.NEUTRAL)}
    out: list[tuple[str, int]] = []
    swap = _swapper(rng)
    for _ in range(rounds):
        for label, phrases in pools.items():
            for ph in phrases:
                filled = re.sub(r"\{(\w)\}", lambda m: rng.choice(slots[m.group(1)]), ph)
                if label and rng.random() < 0.3:
                    ws = filled.split(" ")
                    i = max(range(len(ws)), key=lambda j: (ws[j].strip(".,?!:").lower() in _FLAGGED, rng.random()))
                    ws[i] = _disguise(ws[i], rng)
                    filled = " ".join(ws)
                out.append((filled, label))
        for t, v in samples:
            out.append((swap(t) if rng.random() < 0.4 else t, LABELS.index(v)))
    done: list[tuple[list[str], int]] = []
    for t, label in out:
        if calm and rng.random() < 0.55:
            around = [rng.choice(calm) for _ in range(rng.randrange(1, 3))]
            around.insert(rng.randrange(len(around) + 1), t)
            t = " ".join(around)
        done.append((words_of(t), label))
    # every stretch of harmless text is harmless, whatever its length and whatever its things are called
    plain = [words_of(s) for s in calm] + [words_of(re.sub(r"\{(\w)\}", lambda m: rng.choice(slots[m.group(1)]), ph)) for ph in pools[0]]
    pieces = sorted({w for ws in plain for w in ws if w.isalpha() and len(w) > 3 and w not in _FLAGGED})
    for _ in range(STRETCHES * rounds if calm else 0):
        ws = [w for _ in range(4) for w in rng.choice(plain if rng.random() < 0.3 else plain[: len(calm)])]
        i = rng.randrange(max(1, len(ws) - 4))
        odd = rng.choice((0.0, 0.1, 0.25, 0.5))
        done.append(([_made_up(pieces, rng) if w.isalpha() and rng.random() < odd else w for w in ws[i : i + WINDOW]], 0))
    return done


_FLAGGED = {w for x in [*P.INSULTS, *P.ADJECTIVES, *P.SEXUAL, *P.SLURS] for w in x.split()} | {"fuck", "shit", "ass", "cock", "dick", "horny", "naked"}


def fit(samples: list[tuple[str, str]], seed: int = 7, epochs: int = 4, batch: int = 64) -> bytes:
    """Train on (text, label); returns the pickled model. Equal samples give equal weights."""
    rng = random.Random(seed)
    return _train(training_texts(sorted(samples), rng), rng, seed, epochs, batch)


def _train(data: list[tuple[list[str], int]], rng: random.Random, seed: int, epochs: int, batch: int) -> bytes:
    counts: dict[str, list[int]] = {}
    bare = Words([], [])
    for ws, label in data:
        for w in set(map(bare.plain, ws)):
            counts.setdefault(w, [0, 0])[label > 0] += 1
    vocabulary = sorted(w for w, (a, b) in counts.items() if a + b > 1 and w.isalpha() or w == "0")
    strong = sorted({w for w in _FLAGGED if w.isalpha()} | {w for w in vocabulary if counts[w][0] == 0 and counts[w][1] > 9 and len(w) > 3})
    words = Words(vocabulary, strong)
    net = Net(seed, len(vocabulary))
    table: dict[str, int] = {}
    rows: list[tuple[int, list[int]]] = []

    def row(w: str) -> int:
        w = words.plain(w)
        if w not in table:
            table[w] = len(rows)
            rows.append((words.id.get(w, 0), words.grams(w)))
        return table[w]


    coded = [([row(w) for w in ws], y) for ws, y in data if ws]
    ids = np.array([r[0] for r in rows])
    width = max(len(r[1]) for r in rows)
    grams = np.array([r[1] + [-1] * (width - len(r[1])) for r in rows])
    share = ((grams >= 0) / (grams >= 0).sum(1, keepdims=True)).astype("f4")
    grams = np.maximum(grams, 0)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    noise = np.random.default_rng(seed)
    step = 0
    total = epochs * -(-len(coded) // batch)
    weight = np.array([1.0, 1.0, 1.0, 1.0], "f4")
    for _ in range(epochs):
        order = sorted(range(len(coded)), key=lambda i: (len(coded[i][0]) + rng.random() * 6))
        # batches of nearly equal size, so that no few texts make a step of their own
        chunks = [x.tolist() for x in np.array_split(np.array(order), -(-len(order) // batch))]
        rng.shuffle(chunks)
        for chunk in chunks:
            step += 1
            lengths = np.array([len(coded[i][0]) for i in chunk])
            steps = int(lengths.max())
            at = np.zeros((steps, len(chunk)), int)
            for j, i in enumerate(chunk):
                at[: lengths[j], j] = coded[i][0]
            y = np.array([coded[i][1] for i in chunk])
            uniq, inv = np.unique(at, return_inverse=True)
            inv = inv.reshape(at.shape)
            # a known word is at times read by its signs alone
            known = ids[uniq] * (noise.random(len(uniq)) > 0.25)
            vec = net.p["word"][known] + np.einsum("ug,ugd->ud", share[uniq], net.p["gram"][grams[uniq]])
            drop = ((noise.random(vec.shape) > 0.1) / 0.9).astype("f4")
            vecd = vec * drop
            pf, pb = vecd @ net.p["wf"] + net.p["bf"], vecd @ net.p["wb"] + net.p["bb"]
            keep: dict = {}
            prob = net.forward(pf[inv], pb[inv], lengths, keep)
            soft = np.full(prob.shape, 0.01, "f4")
            soft[np.arange(len(chunk)), y] = 0.97
            dy = ((prob - soft) * weight[y][:, None] / len(chunk)).astype("f4")
            g = net.backward(keep, dy, (steps, len(chunk), 3 * HIDDEN))
            flat = inv.reshape(-1)
            df, db = np.zeros_like(pf), np.zeros_like(pb)
            _add_rows(df, flat, g.pop("xf").reshape(-1, 3 * HIDDEN))
            _add_rows(db, flat, g.pop("xb").reshape(-1, 3 * HIDDEN))
            g["wf"], g["bf"], g["wb"], g["bb"] = vecd.T @ df, df.sum(0), vecd.T @ db, db.sum(0)
            dv = (df @ net.p["wf"].T + db @ net.p["wb"].T) * drop
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            _add_rows(g["word"], known, dv)
            _add_rows(g["gram"], grams[uniq].reshape(-1), (share[uniq][:, :, None] * dv[:, None, :]).reshape(-1, DIM))
            g["word"][0] = 0
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.006 * min(1.0, step / 40) * (1 - 0.9 * step / total)
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (size + 1e-6))
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return pickle.dumps((vocabulary, strong, net.p))


# --- scoring -----------------------------------------------------------------------------------------


class _Rows(dict):
    """Words to rows of inputs; a new word gets one, which the scorer learns before the next windows."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def __missing__(self, w: str) -> int:
        i = self[w] = self.scorer.code(w)
        return i


class Scorer:
    def __init__(self, model: bytes):
        vocabulary, strong, p = pickle.loads(model)
        self.words = Words(vocabulary, strong)
        self.net = Net(0, 0)
        self.net.p = p
        self.reset()

    def reset(self) -> None:
        self.row = _Rows(self)
        self.pf = np.zeros((4096, 3 * HIDDEN), "f4")
        self.pb = np.zeros((4096, 3 * HIDDEN), "f4")
        self.fresh: list[tuple[int, str]] = []
        self.plain_row: dict[str, int] = {}

    def code(self, w: str) -> int:
        s = self.words.plain(w)
        i = self.plain_row.get(s)
        if i is None:
            i = self.plain_row[s] = len(self.plain_row)
            self.fresh.append((i, s))
        return i

    def learn(self) -> None:
        """Input parts of the words that are new since the last batch."""
        if not self.fresh:
            return
        p, need = self.net.p, len(self.plain_row)
        if need > len(self.pf):
            more = np.zeros((need, 3 * HIDDEN), "f4")
            self.pf, self.pb = np.concatenate([self.pf, more]), np.concatenate([self.pb, more])
        lists = [self.words.grams(s) for _, s in self.fresh]
        flat = np.fromiter((x for g in lists for x in g), int)
        sizes = np.array(list(map(len, lists)))
        starts = np.cumsum(sizes) - sizes
        vec = np.add.reduceat(p["gram"][flat], starts) / sizes[:, None] + p["word"][[self.words.id.get(s, 0) for _, s in self.fresh]]
        vec = vec.astype("f4")
        at = [i for i, _ in self.fresh]
        self.pf[at], self.pb[at] = vec @ p["wf"] + p["bf"], vec @ p["wb"] + p["bb"]
        self.fresh = []

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """(texts, labels): of the window in which a text is least harmless; a text without words is harmless."""
        if len(self.row) > KEEP:
            self.reset()
        row_of = self.row.__getitem__
        windows: list[tuple[int, ...]] = []
        owner: list[int] = []
        for k, ws in enumerate(texts):
            ids = list(map(row_of, ws))
            for i in range(0, max(1, len(ids) - (WINDOW - STRIDE)) if ids else 0, STRIDE):
                windows.append(tuple(ids[i : i + WINDOW]))
                owner.append(k)
        out = np.zeros((len(texts), len(LABELS)))
        out[:, 0] = 1
        if not windows:
            return out
        self.learn()
        place: dict[tuple[int, ...], int] = {}
        which = np.array([place.setdefault(w, len(place)) for w in windows])
        uniq = sorted(place, key=len)
        back = np.empty(len(uniq), int)
        back[[place[w] for w in uniq]] = np.arange(len(uniq))
        probs = np.empty((len(uniq), len(LABELS)), "f4")
        for i in range(0, len(uniq), CHUNK):
            part = uniq[i : i + CHUNK]
            lengths = np.array(list(map(len, part)))
            steps = int(lengths.max())
            at = np.zeros((len(part), steps), int)
            at[np.arange(steps) < lengths[:, None]] = np.fromiter(chain.from_iterable(part), int, int(lengths.sum()))
            at = at.T
            probs[i : i + CHUNK] = self.net.forward(self.pf[at], self.pb[at], lengths)
        score = probs[back[which]]
        order = np.lexsort((score[:, 0], np.array(owner)))
        own = np.array(owner)[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] = score[order[first]]
        return out


@lru_cache(maxsize=2)
def scorer_for(model: bytes) -> Scorer:
    return Scorer(model)


_models: dict[str, bytes] = {}


def _digest(rows: list[tuple[str, str]]) -> str:
    """Of all that a fit depends on: the labelled rows and the code."""
    h = hashlib.sha256(repr(sorted(rows)).encode())
    for module in (sys.modules[__name__], P):
        h.update(inspect.getsource(module).encode())
    return h.hexdigest()[:32]


def train(samples: DataFrame, key: str, text: str, verdict: str, max_samples: int = MAX_SAMPLES) -> bytes:
    """Fit on at most ``max_samples`` labelled rows, those of the smallest keys; null texts and unknown labels are left out.

    A model is fitted once for the same rows and code: it is kept in the
    session and in the shared folder, and read from there by later sessions.
    """
    rows = samples.where(c(text).isNotNull() & c(verdict).isin(*LABELS)).orderBy(key, text, verdict).limit(max_samples).select(c(text), c(verdict)).collect()
    pairs = [(r[0], r[1]) for r in rows]
    name = _digest(pairs)
    if name not in _models:
        spark = samples.sparkSession
        path = f"{shared_dir(spark)}/wildloom-models/tone-{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            spark.createDataFrame([(bytearray(fit(pairs)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
        _models[name] = bytes(spark.read.parquet(path).first()["model"])
    return _models[name]


def score(df: DataFrame, texts: list[str], model: bytes) -> DataFrame:
    """``df`` with ``score`` (1 minus the chance of harmless) and ``verdict`` (the likeliest label).

    Each of the columns ``texts`` is read by itself; the worst counts. Nulls
    and empty texts score 0. Columns of these names are replaced. No shuffle.
    """
    columns_or_fail(df, *texts)
    sent = df.sparkSession.sparkContext.broadcast(model)
    keep = [x for x in df.columns if x.lower() not in ("score", "verdict")]

    @F.pandas_udf("struct<score:double,verdict:string>")
    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        s = scorer_for(sent.value)
        for cols in it:
            cols = cols if isinstance(cols, tuple) else (cols,)
            n = len(cols[0])
            probs = s.probabilities([words_of(t) if t else [] for col in cols for t in col]).reshape(len(cols), n, -1)
            worst = probs[probs[:, :, 0].argmin(0), np.arange(n)]
            yield pd.DataFrame({"score": 1 - worst[:, 0], "verdict": np.array(LABELS, object)[worst.argmax(1)]})

    done = df.select(*[c(x) for x in keep], run(*[c(x) for x in texts]).alias("__t"))
    return done.select(*[c(x) for x in keep], F.col("__t.score").alias("score"), F.col("__t.verdict").alias("verdict"))


def rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null as ``-``): n, n_flagged, rate and mean_score."""
    flagged = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    g = scored.groupBy(F.coalesce(c(source).cast("string"), F.lit("-")).alias("source"))
    return g.agg(F.count(F.lit(1)).alias("n"), flagged.alias("n_flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
