import random
import time

import pytest

from weftwork.operators import graph, reports


def frames(spark, nodes, pairs):
    return spark.createDataFrame([(i, float(i % 7)) for i in nodes], "index long, execution double"), spark.createDataFrame([(s, 0, d) for s, d in pairs], "src long, group_no int, dst long")


def direct(nodes, pairs):
    deps = {}
    for s, d in pairs:
        deps.setdefault(s, set()).add(d)
    level, path = {}, {}
    for i in sorted(nodes):  # dependencies have lesser numbers
        level[i] = max((level[d] + 1 for d in deps.get(i, ())), default=0)
        path[i] = float(i % 7) + max((path[d] for d in deps.get(i, ())), default=0.0)
    return level, path


def graphs():
    rnd = random.Random(6)
    yield range(25), {(s, rnd.randrange(s)) for s in range(1, 25) for _ in range(rnd.randint(0, 3))}
    yield range(16), {(s, s - 1) for s in range(1, 16)} | {(15, 3), (9, 2), (4, 0)}
    yield range(3), set()


@pytest.mark.parametrize("rounds", [0, 32])
def test_levels_paths_and_chains(spark, monkeypatch, rounds):
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    for nodes, pairs in list(graphs())[: 1 if rounds else None]:
        n, e = frames(spark, nodes, pairs)
        ranked = graph.levels(n, e)
        level, path = direct(nodes, pairs)
        assert {r["index"]: r.level for r in ranked.collect()} == level
        assert {r["index"]: r.path for r in graph.critical_path(n, e, ranked).collect()} == path
        start, chain = max(level, key=lambda i: (level[i], -i)), []
        while start is not None:
            chain.append(start)
            start = max((d for s, d in pairs if s == start), key=lambda d: (level[d], -d), default=None)
        assert graph.deepest_chain(e, ranked, chain[0]) == chain


def test_cycles_of_chains_and_of_branches(spark):
    for pairs in ({(1, 2), (2, 3), (3, 1)}, {(1, 2), (1, 3), (2, 1), (2, 4)}, {(5, 1), (1, 2), (2, 1), (5, 6)}):
        with pytest.raises(graph.CycleError):
            graph.levels(*frames(spark, range(1, 7), pairs))


def test_a_chain_of_ten_thousand(spark):
    n, e = frames(spark, range(10_000), {(s, s - 1) for s in range(1, 10_000)})
    began = time.time()
    ranked = graph.levels(n, e)
    top = ranked.orderBy("level", ascending=False).first()
    assert (top["index"], top.level) == (9_999, 9_999) and time.time() - began < 120


def test_results_only(spark):
    rows = [(1, "a", [[2, 3], [4]]), (2, "b", []), (3, "step", [[2]]), (4, "d", [[3], [2, 3, 5]]), (5, "e", [[3]])]
    profile = spark.createDataFrame(rows, "index long, name string, depends array<array<long>>")
    got = reports.results_only(profile, profile.where("name <> 'step'")).collect()
    assert {r["index"]: r.depends for r in got} == {1: [[2], [4]], 2: [], 4: [[2, 5]], 5: []}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_not_made_distinct_before_use(spark, monkeypatch):
    n, e = frames(spark, range(5), {(1, 0), (2, 1), (3, 1), (3, 2), (4, 0)})
    twice = e.union(e)
    cuts, own = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(plan(df)) or own(df))
    for run in (lambda x: graph.levels(n, x), lambda x: graph.live(n.where("index = 3"), x), lambda x: graph.closure(n, x)):
        cuts.clear()
        got = sorted(map(tuple, run(twice).collect()))
        assert "Exchange" not in cuts[0] and "Aggregate" not in cuts[0]
        assert got == sorted(map(tuple, run(e).collect())) and len(set(got)) == len(got)


def test_users_take_one_shuffle(spark):
    _, e = frames(spark, range(4), {(1, 0), (2, 0), (3, 1)})
    users = reports.users(e.union(e))
    assert plan(users).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, users.collect())) == [(0, 2, 1, 2), (1, 1, 3, 3)]
