import random

from pyspark.sql import functions as F

from weftwork.operators import ordering, reach


def closure(pairs):
    users = {}
    for s, d in pairs:
        users.setdefault(s, set()).add(d)
    out = {}

    def walk(n):
        if n not in out:
            out[n] = set()
            for d in users.get(n, ()):
                out[n] |= {d} | walk(d)
        return out[n]

    return {(n, d) for n in list(users) for d in walk(n)}


def graphs():
    rnd = random.Random(8)
    yield 30, {(s, rnd.randrange(s)) for s in range(1, 30) for _ in range(rnd.randint(0, 3))}
    yield 25, {(s, s - 1) for s in range(1, 25)} | {(24, 3), (20, 0)}
    yield 20, {(19, d) for d in range(19)} | {(5, 1), (6, 1), (7, 2)}
    yield 6, set()


def test_behind_equals_the_closure(spark):
    for n, pairs in graphs():
        nodes, edges = spark.createDataFrame([(i,) for i in range(n)], "index long"), spark.createDataFrame(sorted(pairs), "src long, dst long")
        index = reach.labels(nodes, edges)
        rows = index.collect()
        assert len(rows) == n and sorted(r.start for r in rows) == list(range(n))
        asked = spark.createDataFrame([(a, b) for a in range(n) for b in range(n)] + [(0, 99), (99, 0)], "src long, dst long")
        got = [(r.src, r.dst) for r in reach.behind(asked, index, edges).collect()]
        assert len(got) == len(set(got)) and set(got) == closure(pairs)


def test_used_but_not_declared(spark):
    """1 uses 2 uses 3; 4 is made from 5. Of what 1 was found to use, 4 is made but not behind it; 5 is a
    source and 3 is behind."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 6), (4, 5)], "src long, dst long")
    index = reach.labels(spark.createDataFrame([(i,) for i in range(1, 7)], "index long"), edges)
    used = spark.createDataFrame([(1, 3), (1, 4), (1, 5), (1, 2), (4, 3), (4, 3), (4, 4)], "src long, dst long")
    assert sorted(map(tuple, reach.not_declared(used, edges, index).collect())) == [(1, 4), (4, 3)]


def test_numbers_and_sums_without_a_single_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 9) if i % 5 else None) for i in range(200)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, k string, v long").repartition(7)
    got = ordering.numbered(frame, [F.col("k").asc_nulls_last(), F.col("id").desc()], "n", {"before": F.col("v")}).collect()
    at, want = 0, {}
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[0]))):
        want[i] = (place, at)
        at += v or 0
    assert {r.id: (r.n, r.before) for r in got} == want
    assert ordering.numbered(frame.where("false"), [F.col("id")], "n").collect() == []


def test_intervals_are_of_what_is_behind_only(spark, monkeypatch):
    """A customer far from its nation: numbers in between are ruled out where it is met, so a round writes no
    row of it; nodes that use nothing have no interval."""
    n = 40
    pairs = {(0, 1), (1, 2), (3, 2)} | {(s, 3) for s in range(4, n)} | {(3, d) for d in range(n, n + 20)} | {(n + 30, n + 31)}
    nodes, edges = spark.createDataFrame([(i,) for i in range(n + 32)], "index long"), spark.createDataFrame(sorted(pairs), "src long, dst long")
    index = reach.labels(nodes, edges)
    at = {r["index"]: r for r in index.collect()}
    assert all((r.low is None) == (i not in {s for s, _ in pairs}) for i, r in at.items())
    assert not at[0].low <= at[0].start <= at[0].high and at[1].low == at[1].high == at[2].start
    cuts, own = [], reach._cut
    monkeypatch.setattr(reach, "_cut", lambda df: cuts.append(own(df)) or cuts[-1])
    asked = spark.createDataFrame([(s, 1) for s in range(4, n)], "src long, dst long")
    assert reach.behind(asked, index, edges).collect() == []
    assert all(c.count() == 0 for c in cuts if "yes" in c.columns)
