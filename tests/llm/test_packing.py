import random
from collections import defaultdict

import numpy as np
import pytest

from wildloom.llm import packing
from wildloom.session import table


def brute(sizes, sources, clusters, capacity):
    """Best fit by trying all containers: the tightest without conflict, else a new one."""
    bins, out = [], {}
    bit = {x for x in clusters if clusters.count(x) > 1}
    needed = max(1.0, sum(sizes) / capacity)
    weight = [n / capacity + packing.PRESSURE * (sources.count(s) if s is not None else 0) / needed for n, s in zip(sizes, sources, strict=True)]
    for i in np.argsort(-np.array(weight), kind="stable"):
        n, s, x = sizes[i], sources[i] if sizes[i] else None, clusters[i] if sizes[i] and clusters[i] in bit else None
        ok = [b for b in bins if b["left"] >= n and (x is None or x not in b["x"]) and (s is None or s not in b["s"])]
        if ok:
            b = min(ok, key=lambda b: b["left"])
        else:
            b = {"left": capacity, "s": set(), "x": set()}
            bins.append(b)
        b["left"] -= n
        b["s"].add(s)
        b["x"].add(x)
        out[i] = b["left"]
    return len(bins), sorted(b["left"] for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_group_against_brute_force(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, rng.randrange(1, 51)]) if rng.random() < 0.2 else rng.randrange(1, 51) for _ in range(120)]
    sources = [None] * 120
    clusters = [rng.randrange(60) for _ in range(120)]
    got = packing.pack_group(np.array(sizes), sources, clusters, 50)
    used = defaultdict(int)
    for b, n in zip(got, sizes, strict=True):
        used[b] += n
    # containers with equal room are interchangeable, so only their number is the same
    assert len(used) == brute(sizes, sources, clusters, 50)[0]


def test_conflicts():
    n = packing.pack_group(np.array([5, 5, 5, 5]), ["s", "s", None, None], [1, 2, 3, 3], 10)
    assert n[2] != n[3]
    apart = packing.pack_group(np.array([6, 6, 4, 4]), ["s", "t", "s", "t"], [1, 2, 3, 4], 10)
    assert apart[0] == apart[3] and apart[1] == apart[2]
    same = packing.pack_group(np.array([2] * 5), ["s"] * 5, [1, 2, 3, 4, 5], 10)
    assert len(set(same)) == 5
    copies = packing.pack_group(np.array([1] * 4), [None] * 4, [7] * 4, 10)
    assert len(set(copies)) == 4
    assert set(packing.pack_group(np.array([0, 0, 0]), ["a"] * 3, [7] * 3, 10)) == {0}


def test_spark_edges(spark):
    rows = [(1, "one two three four five six seven", "a"), (2, None, None), (3, "", "a"), (4, "word " * 3000, "b"), (5, "x y", None), (5, "x y", None), (None, "q", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n int, bin_id int")
    got = packing.pack(df, "doc_id", "text", "source", capacity=8).collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.bin_id] += r.n_tokens
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
    assert max(load.values()) <= 8
    assert set(pieces) == {1, 2, 3, 4, 5, None}
    long = sorted(pieces[4])
    assert [a for a, _ in long] == list(range(0, 8 * len(long), 8)) and all(n == 8 for _, n in long[:-1])
    assert len(pieces[1]) == 1 and len({r.bin_id for r in got if r.doc_id == 5}) == 2
    assert packing.pack(df.limit(0), "doc_id", "text", "source").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "text", "source", capacity=0)


@pytest.mark.parametrize("seed", range(6))
def test_no_group_breaks_a_constraint(seed):
    rng = random.Random(seed)
    n = 400
    sizes = [rng.choice([0, 1, rng.randrange(1, 60), 50]) for _ in range(n)]
    sizes = [min(x, 50) for x in sizes]
    sources = ["hot" if rng.random() < 0.33 else rng.choice([None, *"abcdefgh"]) for _ in range(n)]
    clusters = [rng.randrange(300) for _ in range(n)]
    got = packing.pack_group(np.array(sizes), sources, clusters, 50)
    held = defaultdict(list)
    for i, b in enumerate(got):
        held[b].append(i)
    for items in held.values():
        real = [i for i in items if sizes[i]]
        named = [sources[i] for i in real if sources[i] is not None]
        assert sum(sizes[i] for i in items) <= 50 and len(named) == len(set(named))
        assert len({clusters[i] for i in real}) == len(real)


def test_given_clusters_are_kept_apart(spark):
    df = spark.createDataFrame([(i, f"text number {i}", f"s{i}", 7 if i < 5 else None) for i in range(12)], "doc_id long, text string, source string, near int")
    apart = packing.pack(df, "doc_id", "text", "source", cluster="near").where("doc_id < 5").select("bin_id").distinct().count()
    assert apart == 5 and packing.pack(df, "doc_id", "text", "source").select("bin_id").distinct().count() == 1


def test_copies_in_other_dress(spark):
    rows = [(1, "The same, text!", "a"), (2, "the SAME text", "b"), (3, "the\nsame  text.", "c"), (4, "---", "d"), (5, "***", "e")]
    got = {r.doc_id: r.bin_id for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert len({got[i] for i in (1, 2, 3)}) == 3 and got[4] == got[5]


def test_small_tables_fill_well(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    p = packing.pack(d, "doc_id", "text", "source", group_tokens=100_000)
    assert packing.conflicts(p, d, "doc_id", "text", "source").isEmpty()
    f = packing.fill(p).first()
    assert f.fill > 0.93 and f.most <= packing.CAPACITY
    assert packing.fill(packing.pack(d, "doc_id", "text", "source")).first().fill > 0.97
    assert p.select("doc_id").distinct().count() == d.count()
