import random

import pytest

from weftwork.sources import polling
from weftwork.streaming import machines as m
from weftwork.streaming import progress


def give(machine, inputs):
    state, out = machine.start, []
    for x in inputs:
        state, found = machine.step(state, x)
        out.append(found)
    return out


def test_small_machines():
    assert give(m.scan(lambda a, b: a + b, 0, m.echo()), [1, 2, 3]) == [1, 3, 6]
    assert give(m.old(0, m.echo()), [1, 2, 3]) == [(0, 1), (1, 2), (2, 3)]
    assert give(m.latch(m.echo()), [(True, 1), (True, 2), (False, 3), (True, 4), (False, 5)]) == [1, 1, 3, 3, 5]
    assert give(m.iff(m.lift(lambda x: x > 1, m.echo()), m.always("big"), m.scan(lambda n, _: n + 1, 0, m.echo())), [1, 5, 0]) == [1, "big", 3]
    assert give(m.decay(1, m.lift(lambda x: x[0], m.echo()), m.lift(lambda x: x[1], m.echo())), [(2.0, 1.0), (6.0, 2.0)]) == [2.0, 3.0]
    assert give(m.changes(m.echo()), [1, 1, 2, 2, 1]) == [1, None, 2, None, 1]


def records(n=200):
    rnd = random.Random(7)
    for key in ("a", "b"):
        t = built = count = 0.0
        todo, known, unknown = 60.0, 90.0, 10.0
        for _ in range(n):
            t += rnd.random()
            if rnd.random() < 0.7:
                spent = rnd.random()
                built, count, todo, known = built + spent, count + 1, todo - 1, max(0.0, known - spent)
                unknown = max(0.0, unknown - (rnd.random() < 0.2))
            yield key, t, built, count, todo, known, unknown


SCHEMA = "key string, " + ", ".join(f"{c} double" for c in progress.FIELDS)
OUT = "secs double, perc double"


def test_the_progress_machine_equals_the_plain_one():
    rows = [dict(zip(progress.FIELDS, r[1:])) for r in records()][:200]
    state = progress.State()
    want = []
    for r in rows:
        state, left, percent = progress.step(state, *[r[c] for c in progress.FIELDS])
        want.append((left, percent))
    got = [x for pair in give(m.remaining(), rows) for x in pair]
    assert got == pytest.approx([x for pair in want for x in pair], nan_ok=True)


def test_fold_and_stream_give_the_same(spark, tmp_path):
    frame = spark.createDataFrame(list(records(60)), SCHEMA)
    frame.where("t <= 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.where("t > 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    machine = m.changes(m.lift(lambda pair: tuple(round(x, 6) for x in pair), m.remaining()))
    want = sorted(map(tuple, m.fold(frame, "key", "t", machine, OUT).collect()))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = m.stream(source, "key", "t", machine, OUT).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert running.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and 20 < len(want) < 120


def test_polled_lines_go_on_after_a_restart(spark, tmp_path):
    log, out = tmp_path / "log.txt", str(tmp_path / "out")
    spark.dataSource.register(polling.PolledLines)

    def run():
        lines = spark.readStream.format("polled_lines").option("path", str(log)).load()
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(120)
        return sorted((r.offset, r.value) for r in spark.read.schema("offset bigint, value string").parquet(out).collect())

    log.write_text("one\ntwo\nhal")
    assert run() == [(0, "one"), (4, "two")]
    with log.open("a") as f:
        f.write("f\nthree\n")
    assert run() == [(0, "one"), (4, "two"), (8, "half"), (13, "three")]
    assert len(run()) == 4


def test_parts_of_a_log_have_each_line_once(tmp_path, monkeypatch):
    log = tmp_path / "log"
    lines = ["x" * (i % 13) for i in range(200)]
    log.write_text("".join(f"{x}\n" for x in lines))
    monkeypatch.setattr(polling, "PART_BYTES", 17)
    reader = polling._Reader(str(log))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 20 and [v for p in parts for _, v in reader.read(p)] == lines
