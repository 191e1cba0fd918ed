import json

from weftwork.sources import parsers, sinks


def test_profile_round_trip(spark, tmp_path):
    rows = [(0, 'a"b', 0.25, 0, 0, [], []), (1, "c", 1.00004, 0, 1, [[0]], []), (2, "Root", 2.0, 1, 1, [[0], [1]], [("cc", 0.5, 1.25)])]
    profile = spark.createDataFrame(rows, parsers.PROFILE)
    lines = [r.value for r in sinks.profile_json(profile).orderBy("index").collect()]
    assert lines == ['["a\\"b",0.25,0,0]', '["c",1,0,1,[[0]]]', '["Root",2,1,1,[[0],[1]],[["cc",0.5,1.25]]]']
    (tmp_path / "p.js").write_text("var profile =\n[" + "\n,".join(lines) + "\n]\n;")
    back = parsers.read_profile(spark, str(tmp_path / "p.js")).orderBy("index").collect()
    assert [r.name for r in back] == ['a"b', "c", "Root"] and back[2].depends == [[0], [1]] and back[2].traces[0].command == "cc"
    assert parsers.profile_edges(profile).count() == 3


def test_trace_events(spark):
    lanes = spark.createDataFrame([("cc", 0.5, 1.0, 3)], "command string, start double, stop double, lane int")
    event = json.loads(sinks.trace_events(lanes, 1).first().value)
    assert (event["ts"], event["dur"], event["tid"], event["pid"], event["ph"]) == (500000, 500000, 3, 1, "X")


def test_compilation_database(spark):
    text = "rule cc\n  command = cc $flags -o $out $in\nbuild a.o: cc a.c\n  flags = -O2\nbuild b: phony a.o\n"
    files = spark.createDataFrame([("x", text)], "file string, text string")
    got = [json.loads(r.value) for r in sinks.compilation_database(parsers.ninja_table(files), ["cc"], "/src").collect()]
    assert got == [{"directory": "/src", "command": "cc -O2 -o a.o a.c", "file": "a.c"}]


def test_changed_only(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    old = spark.createDataFrame([("a", "1"), ("b", "0")], "path string, content string")
    assert sorted(r.path for r in sinks.changed_only(new, old).collect()) == ["b", "c"]


def test_progress_text(spark):
    line = "(0.5,Progress {isFailure = Nothing, countSkipped = 1, countBuilt = 2, countUnknown = 3, countTodo = 4, timeSkipped = 2.0e-3, timeBuilt = 1.5, timeUnknown = 0.0, timeTodo = (2.5,1)})"
    row = parsers.read_progress(spark.createDataFrame([(line,)], "value string")).first()
    assert (row.t, row.countTodo, row.timeSkipped, row.todoKnown, row.todoUnknown) == (0.5, 4.0, 0.002, 2.5, 1.0)
