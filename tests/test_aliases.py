import pytest

from weftwork.operators import aliases, graph

WANTED, ALIAS = "id string, pos int, name string", "name string, pos int, dep string"


def listed(spark, wanted, known):
    rows = aliases.expanded(spark.createDataFrame(wanted, WANTED), spark.createDataFrame(known, ALIAS)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.id, r.way)):
        out.setdefault(r.id, []).append(r.name)
    return out


def test_lists_keep_their_order(spark):
    """Nested aliases, one in two lists, one of nothing, and names that are none."""
    known = [("all", 0, "lib"), ("all", 1, "x"), ("all", 2, "empty"), ("lib", 0, "a"), ("lib", 1, "b"), ("empty", 0, None)]
    got = listed(spark, [("p", 0, "y"), ("p", 1, "all"), ("p", 2, "lib"), ("q", 0, "empty"), ("r", 0, "z")], known)
    assert got == {"p": ["y", "a", "b", "x", "a", "b"], "r": ["z"]}


def test_an_alias_of_itself_is_an_error(spark):
    with pytest.raises(graph.CycleError):
        listed(spark, [("p", 0, "a")], [("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a")])
    with pytest.raises(graph.CycleError):
        listed(spark, [("p", 0, "a")], [("a", 0, "a")])
    assert listed(spark, [("p", 0, "x")], [("a", 0, "a")]) == {"p": ["x"]}


def test_a_task_counts_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(aliases, "COUNTED", 50)
    rows = spark.range(1000).selectExpr("id % 300 as id", "id % 3 as name").unionAll(spark.range(1000).selectExpr("id % 300 as id", "id % 3 as name"))
    got = aliases.times(rows)
    assert got.rdd.getNumPartitions() == 40
    assert {(r.id, r.name): r.times for r in got.collect()} == {(i, i % 3): 8 if i < 100 else 6 for i in range(300)}
