import numpy as np
import pyarrow as pa

from weftwork.llm import decontaminate, repeats, simhash, toxicity


def test_equal_contexts_of_different_anchors_do_not_match(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 300))) for _ in range(2)]
    own = repeats.units
    monkeypatch.setattr(repeats, "units", lambda *a: ((h, ctx * np.uint64(0), row, start, n) for h, ctx, row, start, n in own(*a)))
    plan = repeats.Plan(words=False, window=50, anchor=16, within=False)
    batch = pa.record_batch([pa.array([1, 2]), pa.array([0, 0], pa.int32()), pa.array(texts)], ["doc_id", "sub", "text"])
    out = pa.Table.from_batches(list(repeats._scan(plan, np.zeros(0, np.uint64))(iter([batch])))).to_pydict()
    assert repeats.UNIT in out["kind"] and repeats.MARK not in out["kind"]


def test_rows_without_or_with_a_shared_id(spark, monkeypatch):
    passage = " ".join(f"b{i}" for i in range(13))
    docs = spark.createDataFrame([(None, passage), (None, "clean text"), (7, passage), (7, "other text"), (8, None)], "doc_id long, text string")
    kept = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    want = [("7", "other text"), ("8", "None"), ("None", "clean text")]
    assert kept(decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))) == want
    train = [(i, f"{'awful nasty' if i % 2 else 'kind sweet'} {i}") for i in range(100, 160)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in train], "doc_id long, toxic int")
    rows = [(None, "awful nasty"), (None, "kind sweet"), (7, "awful nasty"), (7, "kind sweet")]
    every = spark.createDataFrame(train + rows, "doc_id long, text string")
    assert [x for x in kept(toxicity.remove_toxic(every, labels)) if x[0] in ("None", "7")] == [("7", "kind sweet"), ("None", "kind sweet")]


def test_near_duplicates_keep_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "x"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "None", "None"]


def test_proximity_without_the_rarest_word(spark):
    phrase = [f"p{i}" for i in range(13)]
    texts = [" ".join(phrase[2:]), " ".join(phrase[1:])] + [" ".join(phrase[3:])] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.proximity(docs, spark.createDataFrame([(1, " ".join(phrase))], "item_id long, text string"))
    assert sorted((r.doc_id, r.words) for r in found.collect()) == [(0, 11), (1, 12)]
