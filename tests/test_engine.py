import random

import pyarrow as pa
import pytest

from weftwork.operators import graph, incremental, reports, simulation
from weftwork.sources import parsers
from weftwork.streaming import progress

#: Texts of the format and what they mean.
MAKE = [
    ("", []), ("a:b c\ndef : ee", [("a", ["b", "c"]), ("def", ["ee"])]), ("a: #comment\n#comment : b\nc : d", [("a", []), ("c", ["d"])]), ("a \\\n\t:b", [("a", ["b"])]),
    ("#comment\\    a : b", []), ("a: b c \\\n    d e\n\nf:g", [("a", ["b", "c", "d", "e"]), ("f", ["g"])]), ("foo/bar: \\\r\n c:/a1 \\\r\n x\r\n", [("foo/bar", ["c:/a1", "x"])]),
    ("output.o: src/file/with\\ space.cpp", [("output.o", ["src/file/with space.cpp"])]), ("a: b\\  c", [("a", ["b ", "c"])]), ("a: b\\ c\\ d e", [("a", ["b c d", "e"])]),
]


@pytest.mark.parametrize("text,want", MAKE)
def test_makefile(text, want):
    assert parsers.makefile_rules(text) == want


def test_ninja_and_config():
    rows = parsers.ninja_statements("x = 1\nrule cc\n  command = cc $in $\n    -o $out\nbuild a.o b.o: cc a.c | a.h || gen\n  x = 2\ndefault a.o\n")
    assert [r["kind"] for r in rows] == ["define", "rule", "build", "default"]
    build = rows[2]
    assert (build["outputs"], build["rule"], build["deps_normal"], build["deps_implicit"], build["deps_order_only"], build["binds"]) == (["a.o", "b.o"], "cc", ["a.c"], ["a.h"], ["gen"], {"x": "2"})
    assert parsers.read_config("CFLAGS = -O\nCFLAGS = $CFLAGS -w\nHEADERS = a${x}b") == {"CFLAGS": "-O -w", "HEADERS": "ab"}
    assert parsers.split_args('a "b c" d\\"e') == ["a", "b c", 'd"e']


def test_access_trace(spark):
    lines = spark.createDataFrame([("r|a",), ("m|b|c",), ("noise",), ("w|x y",)], "value string")
    assert [tuple(r) for r in parsers.access_trace(lines).collect()] == [("Read", "a", ""), ("Move", "b", "c"), ("Write", "x y", "")]


def test_cycle(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "index long")
    with pytest.raises(graph.CycleError):
        graph.levels(nodes, spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 0, 1)], "src long, group_no int, dst long"))


def test_flatten(spark):
    rows = [(1, 0, 0, 0, 5), (1, 0, 1, 0, 6), (1, 1, 0, 0, 6), (1, 1, 1, 0, 7)]
    got = graph.flatten_depends(spark.createDataFrame(rows, "src long, list int, group_no int, pos int, dst long")).collect()
    assert sorted((r.group_no, r.pos, r.dst) for r in got) == [(0, 0, 5), (0, 1, 6), (1, 0, 7)]


def test_simulation_against_small_cases():
    execution, depends = [1.0, 2.0, 3.0, 1.0], [[], [], [[0, 1]], [[0], [2]]]
    assert simulation.simulate(execution, depends, 1)[0] == 7.0
    assert simulation.simulate(execution, depends, 2)[0] == 6.0
    assert simulation.precise_path(execution, depends) == 7.0  # the second group waits for the first
    # Group order delays what a task demands later.
    assert simulation.precise_path([5.0, 5.0, 1.0, 1.0], [[], [], [[0], [3]], [[1]]]) >= 6.0


def test_progress_replay_and_show(spark):
    rows = [("a", float(t), 1.0 * t, float(t), 10.0 - t, 10.0 - t, 0.0) for t in range(1, 11)]
    frame = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} double" for c in progress.FIELDS))
    got = progress.replay(frame, "key").orderBy("t").collect()
    assert got[4].actualPerc == 50.0 and abs(got[4].actualSecs - 5.0) < 1e-9 and got[-1].idealSecs == 0
    assert progress.show(65.0, 40.2) == "1m05s (40%)" and progress.show(float("nan"), 101) == "??s (??%)"


def test_progress_stream(spark, tmp_path):
    rows = [("a", float(t), 1.0 * t, float(t), 10.0 - t, 10.0 - t, 0.0) for t in range(1, 11)]
    schema = "key string, " + ", ".join(f"{c} double" for c in progress.FIELDS)
    frame = spark.createDataFrame(rows, schema)
    frame.where("t <= 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.where("t > 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = progress.predict(stream, "key").writeStream.format("memory").queryName("predicted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.t: r.actualSecs for r in spark.table("predicted").collect()}
    want = {r.t: r.actualSecs for r in progress.replay(frame, "key").collect()}
    assert got == want


def test_lanes(spark):
    rows = [("p", "a", 0.0, 2.0), ("p", "b", 1.0, 3.0), ("p", "c", 2.0, 4.0), ("p", "d", 2.5, 5.0)]
    got = simulation.lanes(spark.createDataFrame(rows, "k string, command string, start double, stop double"), "k").collect()
    assert {r.command: r.lane for r in got} == {"a": 0, "b": 1, "c": 0, "d": 2}


def test_random_graphs_against_direct_evaluation(spark):
    """Two incremental runs over random acyclic graphs equal a direct evaluation, and what did not
    have to be computed was not."""
    rnd = random.Random(11)
    n = 14
    deps = {i: rnd.sample(range(i), min(i, rnd.randint(0, 3))) for i in range(n)}
    edges = spark.createDataFrame([(i, 0, d) for i, ds in deps.items() for d in ds], "src long, group_no int, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "index long")
    ranked = graph.levels(nodes, edges)
    from pyspark.sql import functions as F

    rule = lambda rows: rows.select("id", F.array_join(F.transform("deps", lambda d: F.substring(d, 1, 1)), "").alias("digest"))

    def direct(source):
        out = {}
        for i in range(n):
            out[i] = "".join(out[d][:1] for d in sorted(deps[i])) if deps[i] else source[i]
        return out

    source = {i: rnd.choice("ab") for i in range(n) if not deps[i]}
    empty = spark.createDataFrame([], "id long, digest string, built long, changed long")
    frame = lambda s: spark.createDataFrame(list(s.items()), "id long, digest string")
    first = incremental.evaluate(empty, edges, frame(source), rule, ranked, 1)
    assert {r.id: r.digest for r in first.collect()} == direct(source)
    flipped = dict(source)
    some = rnd.choice(list(flipped))
    flipped[some] = "b" if flipped[some] == "a" else "a"
    second = {r.id: r for r in incremental.evaluate(first, edges, frame(flipped), rule, ranked, 2).collect()}
    before, after = direct(source), direct(flipped)
    for i, r in second.items():
        assert r.digest == after[i]
        assert (r.changed == 2) == (before[i] != after[i])
        assert (r.built == 2) == (any(before[d] != after[d] for d in deps[i]) if deps[i] else before[i] != after[i])


def test_exclusive_time_without_partner(spark):
    rows = spark.createDataFrame([("k", 1, 0.0, 2.0), ("k", 2, 5.0, 1.0)], "key string, index long, start double, execution double")
    assert {(r["index"], r.etime, r.wtime) for r in reports.exclusive_time(rows, "key").collect()} == {(1, 2.0, 2.0), (2, 1.0, 1.0)}


def test_makefile_edges_go_out_some_at_a_time(spark):
    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    n = parsers.ROWS + 5
    batch = pa.record_batch([pa.array(["a", None, "b"]), pa.array(["x: " + "d " * n, None, "y z: e"])], ["file", "text"])
    parts = list(parsers.makefile_edges(Files())(iter([batch])))
    assert max(p.num_rows for p in parts) <= parsers.ROWS and sum(p.num_rows for p in parts) == n + 2
    files = spark.createDataFrame([("a", "x: d\\\n e # no"), ("b", "y z: e"), ("c", None)], "file string, text string")
    assert sorted(map(tuple, parsers.makefile_edges(files).collect())) == [("a", "x", 0, "d"), ("a", "x", 1, "e"), ("b", "y", 0, "e"), ("b", "z", 0, "e")]


def test_small_profiles_share_a_batch(spark):
    rows = [(k, i, float(i + k), [[0]] if i else []) for k in range(3) for i in range(3)]
    profile = spark.createDataFrame(rows, "key long, index long, execution double, depends array<array<long>>")
    found = simulation.precise_critical_path(profile, "key")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.seconds for r in found.collect()} == {str(k): k + 2.0 + k for k in range(3)}
    assert {(r.key, r.threads): r.realistic for r in simulation.parallelism(profile, "key", 2).collect()}["1", 1] == 6.0
