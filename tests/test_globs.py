import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions import patterns
from weftwork.functions.pattern_set import PatternSet, matched
from weftwork.operators import rules
from weftwork.sources import globs

from .test_functions import MATCH


def test_automaton_equals_each_pattern():
    for want, pattern, path in MATCH:
        assert (PatternSet([pattern]).match(path) == (0,)) == want, (pattern, path)


def test_automaton_of_many_patterns(spark):
    rnd = random.Random(2)
    make = lambda letters, n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    some = [make("/*ab", 7) for _ in range(60)] + ["**/a*b/**", "./a", "a/./b", "**", "//"]
    names = [make("/ab", 7) for _ in range(150)] + ["./a", "a/./b", "/a"]
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "path string")
    one = frame.select("path", F.array(*[F.coalesce(patterns.matches(p, F.col("path")), F.lit(False)) for p in some]).alias("hits")).collect()
    want = {r.path: [i for i, h in enumerate(r.hits) if h] for r in one} | {None: []}
    got = {r.path: r.matched for r in matched(frame, some).collect()}
    assert got == want and any(len(v) > 3 for v in got.values())


#: The rules, keys and outcomes that such rules are known to have.
RULES = rules.RuleSet(
    rules.rule("or", "or*", "*or"), rules.alternatives(rules.rule("t", "alternative.t*"), rules.rule("any", "alternative.*")),
    rules.priority(100, rules.priority(0, rules.rule("100", "priority.txt"))), rules.priority(50, rules.rule("50", "priority.txt")),
    rules.alternatives(rules.priority(20, rules.rule("20", "altpri.txt")), rules.priority(40, rules.rule("40", "altpri.txt"))), rules.priority(30, rules.rule("30", "altpri.txt")),
    rules.alternatives(rules.priority(21, rules.rule("21", "altpri2.txt")), rules.priority(22, rules.rule("22", "altpri2.txt"))), rules.priority(23, rules.rule("23", "altpri2.txt")),
    rules.priority(55, rules.alternatives(rules.rule("55", "x"))), rules.priority(51, rules.rule("51", "x")), rules.priority(42, rules.alternatives(rules.rule("42", "xx"))), rules.priority(43, rules.rule("43", "xx")),
    rules.priority(10, rules.priority(6, rules.rule("6", "change")), rules.priority(7, rules.rule("7", "change")), rules.priority(8, rules.rule("8", "change"))), rules.priority(9, rules.rule("9", "change")),
    rules.versioned(3, rules.rule("v3", "ver/*"), rules.versioned(4, rules.rule("v4", "ver4/*"))))
CHOSEN = {"or": "or", "alternative.foo": "any", "alternative.txt": "t", "priority.txt": "100", "altpri.txt": "30", "altpri2.txt": "23", "x": "55", "xx": "43", "ver/a": "v3", "ver4/a": "v4", "none": None}


def test_rules(spark):
    keys = spark.createDataFrame([(k,) for k in CHOSEN] + [(None,)], "key string")
    got = {r.key: r for r in rules.one_rule(keys, RULES).collect()}
    assert {k: got[k].rule for k in CHOSEN} == CHOSEN
    assert (got["ver/a"].version, got["ver4/a"].version, got["x"].version, got["none"].version) == (3, 4, 0, None)
    assert got["priority.txt"].matching == 2 and got[None].candidates == 0


def test_several_rules_are_an_error(spark):
    keys = spark.createDataFrame([("change",), ("x",)], "key string")
    with pytest.raises(rules.MultipleRulesError, match="matches multiple rules.*3"):
        rules.one_rule(keys, RULES)
    assert {r.key: (r.candidates, r.rule) for r in rules.rules_of(keys, RULES).collect()} == {"change": (3, None), "x": (1, "55")}


@pytest.fixture
def tree(tmp_path):
    for name in ("A.txt", "B.txt", "C.txt/D.txt", "C.txt/E.xtx", "deep/a/b/c/F.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    return str(tmp_path)


def names(df):
    return [r.path for r in df.collect()]


def test_files(spark, tree):
    assert names(globs.files(spark, tree, ["*.txt"])) == ["A.txt", "B.txt"]
    assert names(globs.files(spark, tree, ["//*.txt"])) == ["A.txt", "B.txt", "C.txt/D.txt", "deep/a/b/c/F.txt"]
    assert names(globs.files(spark, tree + "/C.txt", ["*.txt"])) == ["D.txt"]
    assert names(globs.files(spark, tree, ["*.txt", "//*.xtx"])) == ["A.txt", "B.txt", "C.txt/E.xtx"]
    assert names(globs.files(spark, tree, ["C.txt/*"])) == ["C.txt/D.txt", "C.txt/E.xtx"]
    for missing in ("missing_dir/*", "missing_dir/bar/*", "//missing_dir/*"):
        assert names(globs.files(spark, tree, [missing])) == []
    assert names(globs.files(spark, tree, [])) == []
    with pytest.raises(Exception, match="missing_dir does not exist"):
        names(globs.files(spark, tree + "/missing_dir", ["*"]))


def test_directories_contents_and_probes(spark, tree):
    assert names(globs.directories(spark, tree)) == ["C.txt", "deep"]
    assert names(globs.contents(spark, tree)) == ["A.txt", "B.txt", "C.txt", "deep"]
    asked = spark.createDataFrame([("A.txt",), ("C.txt",), ("none",), (None,), ("C.txt/D.txt",)], "path string")
    got = {r.path: (r.is_file, r.is_dir) for r in globs.exists(asked, tree).collect()}
    assert got == {"A.txt": (True, False), "C.txt": (False, True), "none": (False, False), None: (False, False), "C.txt/D.txt": (True, False)}


#: Which directories have to be listed for some patterns ('' is the root); in others names are looked up.
VISITED = [
    (["*.txt"], {"": "listed"}), (["deep//*.txt"], {"": "probed", "deep": "listed", "deep/a": "listed", "deep/a/b": "listed", "deep/a/b/c": "listed"}), (["deep/a/*.txt"], {"": "probed", "deep": "probed", "deep/a": "listed"}),
    (["A.txt", "C.txt/D.txt"], {"": "probed", "C.txt": "probed"}), (["C.txt/*.txt", "deep//*.c"], {"": "probed", "C.txt": "listed", "deep": "listed", "deep/a": "listed", "deep/a/b": "listed", "deep/a/b/c": "listed"}),
    (["*/a/*.xml"], {"": "listed", "C.txt": "probed", "deep": "probed", "deep/a": "listed"}), ([], {}), (["A.txt"], {"": "probed"}),
]


@pytest.mark.parametrize("some,want", VISITED)
def test_visits_only_what_can_match(spark, tree, some, want):
    got = globs.walk(spark, some, globs.folder(tree)).where("kind in ('listed', 'probed')").collect()
    assert {r.path: r.kind for r in got} == want and len(got) == len(want)


def test_table_walk_equals_folder_walk(spark, tree):
    every = globs.walk(spark, ["//*"], globs.folder(tree)).where("kind = 'file'").select("path")
    table = globs.entry_table(globs.tree_of(every))
    for some in (["//*.txt"], ["*/a/**"], ["C.txt/D.txt", "*.txt"]):
        both = [sorted(map(tuple, globs.walk(spark, some, source).collect())) for source in (table, globs.folder(tree))]
        assert both[0] == both[1]


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    """Steps of one state and the places of large states count, whatever names come."""
    from weftwork.functions import pattern_set

    monkeypatch.setattr(pattern_set, "KEPT", 500)
    patterns = [f"//{a}/{i}*" for a in ("x", "y") for i in range(40)]
    whole, most = pattern_set.PatternSet(patterns), 0
    for i in range(3000):
        name = f"{'xyz'[i % 3]}/{i % 1000}"
        first, n = name.split("/")
        assert set(whole.match(f"h{i}/{name}")) == {k for k, p in enumerate(patterns) if p[2] == first and n.startswith(p[4:-1])}
        states = set(whole._states.values()) if i % 50 == 0 else ()
        most = max([most, *[sum(len(s.steps) + len(s.places) for s in states)]])
    assert most <= 500 + 2 * len(whole.parts)
