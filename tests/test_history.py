import random

from weftwork.operators import history

ENTRY = "entry long, key string, global_version int, builtin_version int, user_version int, result string, noise string"
DEP = "entry long, group_no int, pos int, dep string, identity string"
WANTED = "key string, global_version int, builtin_version int, user_version int"


def frames(spark, entries, current):
    rows = [(e, k, *v, r, "x") for e, k, v, r, _ in entries]
    deps = [(e, g, p, d, i) for e, _, _, _, groups in entries for g, group in enumerate(groups) for p, (d, i) in enumerate(group)]
    return spark.createDataFrame(rows, ENTRY), spark.createDataFrame(deps, DEP), spark.createDataFrame(list(current.items()), "key string, identity string")


def direct(entries, current, wanted):
    """Walks the entries of each key one group at a time."""
    out = {}
    for key, *versions in wanted:
        left, depth = [x for x in entries if x[1] == key and list(x[2]) == versions], 0
        while left:
            ended = [x for x in left if len(x[4]) == depth]
            if ended:
                out[key, *versions] = (min(ended)[0], min(ended)[3])
                break
            asks = [d for d, _ in max(left)[4][depth]]
            left = [x for x in left if [d for d, _ in x[4][depth]] == asks and all(i is not None and current.get(d) == i for d, i in x[4][depth])]
            depth += 1
    return out


def found(spark, entries, current, wanted, **more):
    e, d, c = frames(spark, entries, current)
    rows = history.lookup(spark.createDataFrame(wanted, WANTED), history.tree(e, d), c, **more).collect()
    return {(r.key, r.global_version, r.builtin_version, r.user_version): (r.entry, r.result) for r in rows}


def cases(rnd, n):
    current = {f"d{i}": rnd.choice("xyz") for i in range(12)} | {"none": None}
    entries = []
    for e in range(n):
        groups = []
        for _ in range(rnd.randint(0, 3)):
            asks = rnd.sample(["d0", "d1", "d2", "none"] if rnd.random() < 0.1 else ["d3", "d4"], 2)
            groups.append([(d, current[d] if rnd.random() < 0.7 else rnd.choice("xyz")) for d in sorted(asks)])
        entries.append((e, f"k{rnd.randint(0, 9)}", (1, rnd.randint(0, 1), 0), f"r{e}", groups))
    wanted = [(f"k{k}", 1, b, 0) for k in range(11) for b in (0, 1)]
    return entries, current, wanted


def test_against_a_direct_walk(spark):
    entries, current, wanted = cases(random.Random(4), 120)
    want = direct(entries, current, wanted)
    assert 3 < len(want) < len(wanted)
    assert found(spark, entries, current, wanted) == want
    e, d, _ = frames(spark, entries, current)
    assert found(spark, entries, current, wanted, known=history.filters(e, d)) == want


def test_trees_and_filters_merge_in_any_order(spark):
    entries, current, wanted = cases(random.Random(9), 60)
    parts = [frames(spark, [x for x in entries if x[0] % 3 == i], current)[:2] for i in range(3)]
    whole, deps, now = frames(spark, entries, current)
    rows = lambda t: sorted(map(repr, t.select("node", "depends", "done").collect()))
    trees = [history.tree(e, d) for e, d in parts]
    assert rows(history.merge(*trees)) == rows(history.merge(trees[2], history.merge(trees[1], trees[0]))) == rows(history.tree(whole, deps))
    known = [history.filters(e, d) for e, d in parts]
    assert sorted(map(repr, history.merge_filters(*known).collect())) == sorted(map(repr, history.filters(whole, deps).collect()))


def test_filters_rule_out_but_never_lose(spark):
    """Each key has one entry; a third of them were made with other identities than now."""
    current = {f"d{i}": f"now{i}" for i in range(300)}
    entries = [(i, f"k{i}", (1, 0, 0), f"r{i}", [[(f"d{i}", f"now{i}" if i % 3 else "before")]]) for i in range(300)]
    e, d, c = frames(spark, entries, current)
    wanted = spark.createDataFrame([(f"k{i}", 1, 0, 0) for i in range(300)] + [("other", 1, 0, 0)], WANTED)
    left = {r.key for r in history.plausible(wanted, history.filters(e, d), c).collect()}
    assert {f"k{i}" for i in range(300) if i % 3} <= left and len(left) < 240


def test_versions_and_no_entries(spark):
    entries = [(1, "k", (1, 0, 0), "a", []), (2, "k", (1, 0, 1), "b", [])]
    assert found(spark, entries, {}, [("k", 1, 0, 0), ("k", 1, 0, 1), ("k", 2, 0, 0), ("k", 1, 1, 0)]) == {("k", 1, 0, 0): (1, "a"), ("k", 1, 0, 1): (2, "b")}
    assert found(spark, [], {}, [("k", 1, 0, 0)]) == {}


def test_only_what_is_wanted_is_walked(spark, monkeypatch):
    """The same rows as a lookup; what no wanted key leads to is not written, and a lookup makes its tree once."""
    entries, current, wanted = cases(random.Random(5), 150)
    e, d, c = frames(spark, entries, current)
    asked, sizes = spark.createDataFrame(wanted[:6] + wanted[:2], WANTED), []
    cut = history._cut
    monkeypatch.setattr(history, "_cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    rows = history.find(asked, history.nested(e, d), c).collect()
    assert {(r.key, *(r[1:4])): (r.entry, r.result) for r in rows} == direct(entries, current, wanted[:6]) and len(rows) == len(set(rows)) > 1
    assert sizes[0] == sum((k, *v) in wanted[:6] for _, k, v, *_ in entries) < 60 and sizes[::2] == sorted(sizes[::2], reverse=True)
    assert history.find(asked.limit(0), history.nested(e, d), c).collect() == []
    sizes.clear()
    history.lookup(asked, nodes := history.tree(e, d), c)
    assert sizes[0] == nodes.count()
