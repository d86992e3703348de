import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wildloom.operators import hierarchy, hotkeys, orphans, rejects
from wildloom.operators.skew import heavy_keys, lookup_join

T0 = dt.datetime(2020, 1, 1)


# --- 1


def brute_activity(rows):
    by = defaultdict(list)
    for k, t, v, i in rows:
        if k is not None:
            by[k].append((t, v))
    out = {}
    for k, xs in by.items():
        ts = sorted(t for t, _ in xs if t is not None)
        gaps = [(b - a).total_seconds() for a, b in zip(ts, ts[1:], strict=False)]
        bursts = (1 + sum(g > 86400 for g in gaps)) if ts else 0
        out[k] = (len(xs), ts[0] if ts else None, ts[-1] if ts else None, int(max(gaps)) if gaps else None, bursts, sum(v or 0 for _, v in xs))
    return out


SCHEMA = "k string, t timestamp_ntz, v int, i int"


@pytest.mark.parametrize("partitions,chunk", [(1, 3), (5, 7), (16, 1), (3, 1000)])
def test_hot_keys_against_brute_force(spark, partitions, chunk):
    rng = random.Random(partitions)
    rows = []
    for i in range(900):
        k = "hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.randrange(40)}"
        t = None if rng.random() < 0.1 or k == "k1" else T0 + dt.timedelta(hours=rng.randrange(3000))
        rows.append((k, t, None if rng.random() < 0.2 else rng.randrange(9), i))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    order = hotkeys.KeyedOrder(df, "k", "t", "v", "i", partitions)
    got = {r.key: (r.n_rows, r.first_time, r.last_time, r.max_gap_s, r.n_bursts, r.value_sum) for r in order.results(chunk).collect()}
    assert got == brute_activity(rows)
    numbers = defaultdict(list)
    for r in order.numbered().collect():
        numbers[r.key].append(r.row_no)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    assert order.states(chunk).agg(F.max("n")).first()[0] <= chunk


def test_times_do_not_depend_on_the_session_zone(spark):
    rows = [("a", dt.datetime(2021, 3, 14, h, 30, 0, 250_000), 1, h) for h in (1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = hotkeys.KeyedOrder(df, "k", "t", "v", "i").results().first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r.first_time, r.last_time, r.max_gap_s) == (rows[0][1], rows[2][1], 3600)


def test_hot_share_is_exact_and_edges(spark):
    rows = [("a", T0, 1, 0)] * 2 + [("b", T0, 1, 1)] + [(None, None, None, 2)] * 97
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.hot_key, r.n_rows) for r in hotkeys.hot_keys(df, "k", "t", "v", "i").collect()} == {("a", 2)}
    empty = df.limit(0)
    assert hotkeys.hot_keys(empty, "k", "t", "v", "i").count() == 0
    assert hotkeys.KeyedOrder(empty, "k", "t", "v", "i").results().count() == 0
    clash = df.withColumn("key", F.lit(1)).withColumn("pid", F.lit(2)).withColumn("tie", F.lit(3))
    assert hotkeys.KeyedOrder(clash, "k", "t", "v", "i").results().count() == 2


# --- skew helpers


def test_lookup_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 60)] + [(None, 0)], "k int, x int")
    side = spark.createDataFrame([(k, f"n{k}") for k in range(1, 40)], "k int, name string")
    assert [r.k for r in heavy_keys(rows, "k").collect()] == [1]
    assert lookup_join(rows, side, "k").count() == 500 + 38
    left = lookup_join(rows, side, "k", "left")
    assert left.count() == rows.count() and left.where("name is null").count() == 21
    assert lookup_join(rows.limit(0), side, "k").count() == 0
    with pytest.raises(ValueError):
        lookup_join(rows, side, "k", "right")


# --- 2

GOOD = '7,0,2,bob,2008-03-15 18:44:08,"a ""b"", c\nd",,5,,http://x,3,,'


def errors(spark, payload, **more):
    df = spark.createDataFrame([(1, payload)], "record_id long, payload string")
    return rejects.check_records(df).first().errors


@pytest.mark.parametrize(
    "payload,want",
    [
        (GOOD, []), (None, ["no record"]), ("", ["columns:1"]), (GOOD + ",", ["columns:14"]), (GOOD[:-1], ["columns:12"]), (GOOD + "\n", ["quoting"]),
        (GOOD.replace("bob", '"bob'), ["quoting"]), (GOOD.replace("bob", 'bo"b"'), ["quoting"]), (GOOD.replace("bob", '"b"ob'), ["quoting"]), (GOOD.replace("bob", ' "bob"'), ["quoting"]),
        (GOOD.replace("bob", '"b,""""o"'), []), (GOOD.replace("bob", '""'), []), (GOOD.replace("7,", "-7,", 1), []), (GOOD.replace("7,", "+7,", 1), ["invalid:id"]),
        (GOOD.replace("7,", "2147483648,", 1), ["invalid:id"]), (GOOD.replace("7,", "007,", 1), []), (GOOD.replace("7,", " 7,", 1), ["invalid:id"]), (GOOD.replace("7,", "７,", 1), ["invalid:id"]),
        (GOOD.replace("7,", ",", 1), ["missing:id"]), (GOOD.replace(",2,bob", ",6,bob"), ["invalid:type"]), (GOOD.replace(",2,bob", ",,bob"), ["missing:type"]),
        (GOOD.replace("2008-03-15", "2008-02-30"), ["invalid:time"]), (GOOD.replace("18:44:08", "24:00:00"), ["invalid:time"]), (GOOD.replace("18:44:08", "18:44:08Z"), ["invalid:time"]), (GOOD.replace("15 18", "15T18"), ["invalid:time"]),
        (GOOD.replace("7,0,", "7,2,", 1), ["invalid:deleted"]), (GOOD.replace("c\nd", "c\x00d"), ["invalid:text"]), (GOOD.replace("c\nd", "c\td\r"), []), (GOOD.replace("c\nd", "�"), ["invalid:text"]),
        (GOOD.replace("bob", "b\x07b"), []), (GOOD.replace("bob", "ba"), []), (GOOD.replace("c\nd", '""' * 20_000), []), (GOOD.replace("c\nd", "x," * 100_000), []),
    ],
)
def test_record_rules(spark, payload, want):
    assert errors(spark, payload) == want


def test_values_come_out_as_written(spark):
    df = spark.createDataFrame([(1, GOOD.replace("bob", "ba"), 9, "q")], "record_id long, payload string, errors int, values string")
    checked = rejects.check_records(df)
    r = rejects.load_valid(checked, "record_id").first()
    assert (r.id, r.deleted, r.type, r.by, r.time, r.text, r.dead, r.parent, r.url, r.score, r.title) == (7, 0, 2, "ba", dt.datetime(2008, 3, 15, 18, 44, 8), 'a "b", c\nd', None, 5, "http://x", 3, None)
    assert rejects.rejected(checked, "record_id").count() == 0
    empty = rejects.check_records(df.limit(0))
    assert rejects.load_valid(empty, "record_id").count() == 0
    several = spark.createDataFrame([(1, ",0,9,b,x,t,5,,,,,,")] * 2, "record_id long, payload string")
    assert rejects.rejected(rejects.check_records(several), "record_id").first().reason == "missing:id; invalid:type; invalid:time; invalid:dead"


# --- 5


def brute_forest(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None:
            old = parent.get(i)
            parent[i] = p if old is None or (p is not None and p > old) else old
    parent = {i: (None if p in (None, 0) else p) for i, p in parent.items()}
    placed, cycles = {}, {}
    for i in parent:
        path, at = [i], parent[i]
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            placed[i] = (path[-1], path[::-1], True)
        elif at not in parent:
            placed[i] = (path[-1], path[::-1], False)
        else:
            cycles[i] = min(path[path.index(at) :])
    return placed, cycles


def check_forest(spark, pairs):
    f = hierarchy.build_forest(spark.createDataFrame(pairs, "id int, parent int"))
    placed, cycles = brute_forest(pairs)
    got = {r.id: (r.root, list(r.path), r.rooted) for r in f.placed.collect()}
    assert got == placed
    assert {r.id: r.cycle_id for r in f.cycles().collect()} == cycles
    under = defaultdict(int)
    for _, path, _ in placed.values():
        for a in path[:-1]:
            under[a] += 1
    assert {r.ancestor: r.n_descendants for r in f.descendant_counts().collect()} == dict(under)


def test_forest_random(spark):
    rng = random.Random(1)
    pairs = [(1, None), (2, 0), (3, 1), (4, 4), (5, 6), (6, 7), (7, 5), (8, 5), (9, 8), (10, 999), (11, 10), (None, 1), (3, 1)]
    pairs += [(i, 1 if rng.random() < 0.4 else rng.choice([None, rng.randrange(20, 320)])) for i in range(20, 300)]
    check_forest(spark, pairs)


def test_forest_long_chain_and_long_cycle(spark):
    check_forest(spark, [(i, i - 1 if i > 1 else None) for i in range(1, 30)] + [(100 + i, 100 + (i + 1) % 23) for i in range(23)] + [(200 + i, 201 + i) for i in range(9)] + [(209, 117)])


def test_forest_empty_and_only_cycle(spark):
    f = hierarchy.build_forest(spark.createDataFrame([], "id int, parent int"))
    assert f.placed.count() == 0 and f.cycles().count() == 0 and f.descendant_counts().count() == 0
    check_forest(spark, [(1, 2), (2, 1)])


def test_a_star_below_a_cycle_has_no_hot_task(spark):
    n = 400_000
    rows = spark.range(2, n).selectExpr("id", "case when id < 2000 or id % 2 = 0 then 1 else id - 1 end as parent").unionByName(spark.createDataFrame([(1, 1)], "id long, parent long"))
    f = hierarchy.build_forest(rows, paths=False)
    assert f.placed.isEmpty()
    by_cycle = f.cycles().groupBy("cycle_id").count().collect()
    assert [tuple(r) for r in by_cycle] == [(1, n - 1)]


# --- 6


def test_orphans(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    parents = {
        "items": spark.createDataFrame([(1, False, day(0)), (2, True, day(0)), (3, False, day(50)), (4, None, None), (None, True, day(1)), (1, False, day(0))], "id int, flag boolean, time timestamp_ntz"),
        "old": spark.createDataFrame([(9, True, day(40))], "id int, flag boolean, time timestamp_ntz"),
    }
    kids = [(10, 1, day(1)), (11, 2, day(1)), (12, 3, day(1)), (13, 4, day(1)), (14, 77, day(1)), (15, None, day(1)), (16, 0, day(1)), (17, 9, day(1)), (18, 3, None), (14, 77, day(1)), (19, 77, None)]
    kids += [(1000 + i, 88, day(1)) for i in range(400)]
    refs = spark.createDataFrame(kids, "id int, key int, child_time timestamp_ntz").withColumn("flag", F.lit("x"))
    found = orphans.find_orphans(parents, refs)
    got = {(r.id, r.reason) for r in found.where("id < 1000").collect()}
    assert got == {(11, "deleted"), (12, "late"), (14, "missing"), (17, "deleted"), (17, "late"), (19, "missing")}
    report = {(r.ref_table, r.month, r.reason): (r.n_refs, r.n_keys) for r in orphans.orphan_report(parents, refs).collect()}
    assert report["none", "2020-01", "missing"] == (401, 2) and report["old", "2020-01", "late"] == (1, 1) and report["none", None, "missing"] == (1, 1)
    assert orphans.find_orphans(parents, refs.limit(0)).count() == 0
    assert orphans.find_orphans({k: v.limit(0) for k, v in parents.items()}, refs.where("id = 10")).first().reason == "missing"


def test_orphan_counts_are_those_of_the_rows(spark):
    rng = random.Random(5)
    hour = lambda n: None if n is None else T0 + dt.timedelta(hours=n)
    maybe = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    parents = {n: spark.createDataFrame([(rng.randrange(30), rng.choice([True, False, None]), hour(maybe(3000))) for _ in range(12)], "id int, flag boolean, time timestamp_ntz").dropDuplicates(["id"]) for n in ("b", "a")}
    kids = spark.createDataFrame([(i % 700, rng.choice([7, rng.randrange(40), None]), hour(maybe(3000))) for i in range(800)], "id int, key int, child_time timestamp_ntz")
    want = defaultdict(lambda: [0, set()])
    for r in orphans.find_orphans(parents, kids).collect():
        x = want[r.ref_table, r.child_time and r.child_time.strftime("%Y-%m"), r.reason]
        x[0] += 1
        x[1].add(r.key)
    got = {(r.ref_table, r.month, r.reason): (r.n_refs, r.n_keys) for r in orphans.orphan_report(parents, kids).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()} and {k[2] for k in got} == {"missing", "deleted", "late"}
    assert orphans.orphan_report(parents, kids.limit(0)).count() == 0


def test_descendants_of_all_nodes(spark):
    parent = {1: None, 2: 1, 3: 2, 4: 99, 5: 6, 6: 7, 7: 5, 8: 5, 9: 8, 10: 10, 11: 10, 12: 0}
    want = {}
    for d in parent:
        seen, at, k = {d}, parent[d], 1
        while at in parent and at not in seen:
            want[at, d] = k
            seen.add(at)
            at, k = parent[at], k + 1
    forest = hierarchy.build_forest(spark.createDataFrame(list(parent.items()), "id int, parent int"))
    assert {(r.ancestor, r.descendant): r.distance for r in forest.all_descendants().collect()} == want and forest.all_descendants().count() == len(want)
    counts = {r.id: (r.n_descendants, r.height) for r in forest.all_descendant_counts().collect()}
    assert counts == {i: (sum(a == i for a, _ in want), max([k for (a, _), k in want.items() if a == i], default=0)) for i in parent}
