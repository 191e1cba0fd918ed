import math
import random

import pytest
from pyspark.sql import functions as F

from weftwork.llm import negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"


def brute(rows, asked, k=5, n=5):
    kept = [(i, label, [math.floor(256 * x) for x in e]) for i, e, label in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, label, v in kept:
        if asked(i):
            anchors[i] = min(anchors.get(i, (str(label), v)), (str(label), v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, str(other) == label) for i, other, w in kept if i != a and len(w) == len(v))
        for place, (s, p, _) in enumerate([x for x in scored if x[2]][:k], 1):
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:n]
            out += [(a, p, place, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, asked=None, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("id") % 10 == 0 if asked is None else asked, **more).collect())


def random_rows(rnd, n, width, labels, near=0.3):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [float(f"{x + near * rnd.gauss(0, 1):.4f}") for x in c], rnd.randrange(labels)))
    return out


@pytest.mark.parametrize("labels,near", [(2, 0.05), (4, 0.5)])
def test_against_brute_force(spark, labels, near):
    rows = random_rows(random.Random(labels), 300, 8, labels, near)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want


def test_small_parts_and_cells(spark, monkeypatch):
    """Many groups, blocks and parts give the same rows, and cells prune: far rows are not sent to a group."""
    monkeypatch.setattr(negatives, "GROUPS", 6)
    monkeypatch.setattr(negatives, "PIVOTS", 10)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 300)
    monkeypatch.setattr(negatives, "ROW_BYTES", 10_000)
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = [(i, [x / math.hypot(*e) for x in e], label) for i, e, label in random_rows(random.Random(5), 400, 6, 3, 0.02)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    join = negatives.Join(negatives.usable(frame, F.col("label"), 256), F.col("id") % 10 == 0)
    bars = join.own_bar(5, F.col("id") % 10 == 0)
    anchors = join.anchors.join(bars, "id", "left")
    left, sent = join.serve(anchors, F.col("bar"), F.lit(None))
    groups = left.select("g").distinct().count()
    assert groups > 2 and sent.select("g", "id").distinct().count() < 0.7 * groups * 400


def test_ties_and_a_hot_vector(spark):
    """A third of all rows share one vector; ties go to lesser ids."""
    rnd = random.Random(3)
    rows = random_rows(rnd, 200, 4, 3, 0.3) + [(1000 + i, [0.5, 0.25, 0.5, 0.25], rnd.randrange(3)) for i in range(100)]
    rnd.shuffle(rows)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_rows_that_take_no_part(spark):
    """Nulls in every column, non-finite and null components, empty vectors, several widths, repeated ids,
    labels alone, anchors without partners, positives with a score of 0 and below."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.2], 2), (4, [nan, 0.0], 1), (5, [inf, 0.0], 2), (6, [None, 1.0], 1), (7, None, 1), (None, [1.0, 0.0], 1),
        (8, [1.0, 0.0], None), (10, [], 1), (11, [], 1), (12, [], 2), (20, [1.0, 1.0, 1.0], 1), (21, [1.0, 1.0, 0.5], 1), (22, [1.0, 0.9, 0.5], 3), (30, [-1.0, 0.0], 5), (31, [0.0, 1.0], 5), (32, [1.0, 0.0], 5),
        (33, [0.0, -1.0], 6), (40, [0.3, 0.3], 9), (50, [0.0, 0.0], 7), (51, [0.0, 0.0], 7), (52, [0.0, 0.0], 8), (1, [1.0, 0.5], 1), (60, [0.2, 0.9], 2), (60, [0.1, 0.9], 1)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and {r[0] for r in got} >= {0, 10, 20, 50}
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_large_components(spark):
    rows = [(i, [1e5 * (i % 7), 3e4, -2e5 * (i % 3)], i % 2) for i in range(40)]  # products beyond 2**50
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = [(a, p, rank, n, s, t) for a, p, _, rank, n, s, t in brute(rows, lambda i: i % 100 == 0)]
    got = queries.op13_hard_negatives(spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
