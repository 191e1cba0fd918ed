from glob import glob

import pyarrow as pa
import pyarrow.parquet as pq

from weftwork.llm import common, decontaminate, toxicity


def test_shards_of_a_task_are_not_written_or_read_at_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1 << 12)
    monkeypatch.setitem(common.WIDE_WRITE, "parquet.block.size", "4096")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(900))) for i in range(40)], "doc_id long, text string").coalesce(1)
    postings = decontaminate.stored(docs)
    files = glob(postings._weftwork_path.removeprefix("file://") + "/*.parquet")
    rows = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(rows) == 40 and max(rows) <= 4
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows] * b.num_rows, pa.int64())], ["n"]) for b in batches)
    with common.settings(spark, common.WIDE_READ):
        read = postings.mapInArrow(sizes, "n bigint").collect()
    assert len(read) == 40 and max(r.n for r in read) <= 2
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    hits = decontaminate.matches(docs, spark.createDataFrame([(5, " ".join(f"w7x{j}" for j in range(13)))], "item_id long, text string"))
    assert spark.conf.get(key) == before and [(r.doc_id, r.hits, r["items"]) for r in hits.where("size(hits) > 0").collect()] == [(7, [0, 13], [5])]


def test_the_driver_neither_trains_nor_holds_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "kind sweet river" if i % 2 else "vile awful river") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", None)
    model = toxicity.fit(docs, labels)
    assert [r.predicted for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [1, 0] * 30
    assert sorted(map(tuple, toxicity.sample(docs, labels, per_class=7).groupBy("toxic").count().collect())) == [(0, 7), (1, 7)]
