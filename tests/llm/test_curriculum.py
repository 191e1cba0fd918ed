import hashlib

import pytest
from pyspark.sql import functions as F

from weftwork.llm import curriculum, queries

DOCS = "doc_id long, text string, source string, size string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], DOCS)


def mixed(spark, rows, **more):
    weight = F.col("rank") % 3 + 1
    knots = F.array(*[F.struct(F.lit(t).alias("t"), (w * weight).cast("double").alias("weight")) for t, w in ((0.0, 1.5), (1.0, 0.5))])
    return curriculum.mix(frame(spark, rows), knots, weight, **more)


def shares(sizes, weights, most=3):
    """Round after round: what is above its bound stops there, the rest is shared again."""
    total, bounded = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in bounded)
        free = sum(w for i, w in enumerate(weights) if i not in bounded)
        target = [most * s if i in bounded else (left * w / free if free else 0) for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, t in enumerate(target) if t > most * sizes[i]}
        if not over:
            return target
        bounded |= over


def by_source(rows):
    out = {}
    for d, text, source in rows:
        out.setdefault(source, []).append((d, len((text or "").split())))
    return out


@pytest.mark.parametrize("sizes", [[100, 10, 1, 1], [5, 5, 5], [1000, 1, 1, 1, 900, 2, 3], [7], [0, 3, 0], [0]])
def test_targets(spark, sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    rows = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
    got = {r.source: r.target for r in curriculum.targets(rows).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(shares(sizes, weights))


def test_taken_words_meet_targets(spark):
    """Null and shared doc_ids, null texts and sources, repeated rows, a source of one third of all rows."""
    rows = [(i, "w " * (i % 50), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(300)]
    rows += [(None, "a b c", None), (None, None, None), (5, "x y", "s1"), (5, "x y", "s1"), (5, "x y", "s1"), (1000, "w " * 5000, "é"), (1001, "one", "\U0001f600"), (1002, "", "empty")]
    got = mixed(spark, rows).collect()
    own = by_source(rows)
    names = sorted([s for s in own if s is not None], key=lambda s: s.encode()) + [None]
    want = dict(zip(names, shares([sum(n for _, n in own[s]) for s in names], [i % 3 + 1 for i in range(len(names))])))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in got) == sorted((d if d is not None else -1, n) for s in own for d, n in own[s])
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    # The order within a source is that of the MD5 of doc_id; each document's words by brute force.
    for s in names:
        order = sorted(own[s], key=lambda x: (hashlib.md5(str("" if x[0] is None else x[0]).encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1]))
        total, taken = sum(n for _, n in order), {}
        demand, at = round(want[s]), 0
        for d, n in order:
            taken.setdefault((d, n), []).append(sum(max(0, min(demand - at - p * total, n)) for p in range(4)) if n else 0)
            at += n
        mine = {}
        for r in got:
            if r.source == s:
                mine.setdefault((r.doc_id, r.size), []).append(r.taken)
        assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in taken.items()}


def test_positions_invert_the_integral(spark):
    """Of a schedule from 1.5 to 0.5 the integral is 1.5 t - t * t / 2."""
    rows = [(i, "w " * 10, "a") for i in range(40)]
    got = mixed(spark, rows).collect()
    order = sorted(range(40), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    assert [r.doc_id for r in got] == order  # one pass: documents come in the order of their places
    for place, r in enumerate(got):
        t = r.positions[0]
        assert 1.5 * t - t * t / 2 == pytest.approx(place / 40) and len(r.positions) == 1


def test_schedules_with_knots_and_pauses(spark):
    knots = [(0.0, 0.0), (0.25, 0.0), (0.5, 2.0), (1.0, 1.0)]
    segments = curriculum.integrated(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("weight")) for t, w in knots]))
    total = 0.25 + 0.75
    shares_ = [0.0, 0.1, 0.25, 0.5, 0.99]
    got = spark.range(1).select(*[curriculum.inverted(segments, F.lit(s)).alias(f"s{i}") for i, s in enumerate(shares_)]).first()

    def integral(t):
        if t <= 0.25:
            return 0.0
        if t <= 0.5:
            return 4 * (t - 0.25) ** 2
        return 0.25 + 2 * (t - 0.5) - (t - 0.5) ** 2

    assert [integral(t) / total for t in got] == pytest.approx(shares_)
    assert got[0] == 0.25


def test_passes_in_training_order(spark):
    rows = [(i, "w " * (i + 1), "a") for i in range(4)] + [(10 + i, "w " * 50, "b") for i in range(4)]
    whole = mixed(spark, rows)
    order = curriculum.training_order(whole).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    taken = {}
    for r in order:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.tokens
    assert taken == {r.doc_id: r.taken for r in whole.collect() if r.taken}
    assert max(r["pass"] for r in order) == 2  # source a is small: three times


def test_no_rows_and_many_equal_rows(spark, monkeypatch):
    assert mixed(spark, []).collect() == []
    monkeypatch.setattr(curriculum, "REPEAT_ROWS", 7)
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 10)
    got = mixed(spark, [(1, "a b", "a")] * 50 + [(2, "a b c", "a")] * 3 + [(3, "z " * 200, "b")]).collect()
    assert len(got) == 54 and sum(r.taken for r in got if r.source == "a") == pytest.approx([r.target for r in got if r.source == "a"][0], abs=1)
    assert mixed(spark, [(1, "", "a"), (2, None, None)]).select(F.sum("taken")).first()[0] == 0


def test_query_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    first, second = (sorted(map(tuple, queries.op12_curriculum(spark, sf).collect())) for _ in range(2))
    assert first == second and len(first) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_plan_is_native(spark):
    """DataFrame functions alone: no Python in the plan."""
    plan = queries.op12_curriculum(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
