"""The registered queries of the training-data operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import automaton, bitslice, bpe, curriculum, decontaminate, htmltext, interaction, negatives, runlength, simhash, toxicity, transducer, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, threshold=0.7)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength.long_repeats(table(spark, sf_dir, "documents"), window=50).drop("spans", "text_sha256")


#: Fixed values of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.repeated_passages(table(spark, sf_dir, "documents"), window=20).drop("spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interaction.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.audit(rows, list("ABCDE")).drop("filter")


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of weight 1 fade from 1.5 times their weight to half of it, those of weight 3 grow from half
    to 1.5 times, those of weight 2 stay as they are."""
    weight = F.col("rank") % 3 + 1
    knot = lambda t, x: F.struct(F.lit(float(t)).alias("t"), (x * weight).cast("double").alias("weight"))
    tilt = (weight - 2) / 2.0
    mixed = curriculum.mix(table(spark, sf_dir, "documents"), F.array(knot(0, 1 - tilt), knot(1, 1 + tilt)), weight)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label).drop("positive_place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: DuckDB has no XXH64 with a seed, no byte-pair merges, no model and no page renderer; the others
#: of these queries are tested against brute force.
SQL = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce("text", '')))) AS x FROM documents WHERE doc_id IS NOT NULL),
        -- Pieces of 512 bytes and the 49 after them: taking strings from a long text costs its length each time.
        y AS (SELECT doc_id, k, substr(x, 1024 * k + 1, 1122) AS y FROM (SELECT doc_id, x, unnest(range(0, CAST((length(x) + 1023) // 1024 AS BIGINT))) AS k FROM d)),
        b AS (SELECT doc_id, k, y, unnest(range(1, CAST(least(512, length(y) // 2) AS BIGINT) + 1)) AS j FROM y),
        w AS (SELECT doc_id, 512 * k + j AS p, substr(y, 2 * j - 1, 2) AS byte, CASE WHEN 2 * j + 98 <= length(y) THEN substr(y, 2 * j - 1, 100) END AS run FROM b),
        s AS (SELECT run, min(doc_id) AS least FROM w WHERE run IS NOT NULL GROUP BY run),
        c AS (SELECT doc_id, p, byte, coalesce(max(doc_id > least) OVER (PARTITION BY doc_id ORDER BY p ROWS 49 PRECEDING), FALSE) AS gone FROM w LEFT JOIN s USING (run)),
        g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS opens FROM c),
        k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op6_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[p:p + least(len(words), 13) - 1], ' ') AS run
              FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS p FROM i WHERE len(words) > 0)),
        lengths AS (SELECT DISTINCT n FROM v),
        o AS (SELECT r, p, n, item_id FROM (SELECT r, n, p, array_to_string(words[p:p + n - 1], ' ') AS run FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, lengths WHERE len(words) >= n)) JOIN v USING (n, run)),
        h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM o)) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, p, words[p] AS word, CASE WHEN p + 19 <= len(words) THEN array_to_string(words[p:p + 19], ' ') END AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)),
        n AS (SELECT doc_id, p, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS late FROM w),
        c AS (SELECT doc_id, p, word, max(late) OVER (PARTITION BY doc_id ORDER BY p ROWS 19 PRECEDING) AS gone FROM n),
        k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce("text", '') AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
        f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x),
                regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > least, FALSE)] AS fails,
              EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS bad FROM w),
        g AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
        l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
        j AS (SELECT part, o, step, fails[o[step]] AS now, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS before, len(list_filter(fails, lambda v: v)) AS total, good, bad, n FROM g, s),
        r AS (SELECT part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') AS filter_order, step, o[step] AS own,
                coalesce(sum(n) FILTER (NOT before AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (NOT before AND now), 0) AS removed, coalesce(sum(n) FILTER (before AND now), 0) AS redundant,
                coalesce(sum(n) FILTER (now AND total = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT before AND now AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT before AND now AND bad), 0) AS toxic_lost
              FROM j GROUP BY part, o, step)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
          CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """,
    "op12_curriculum": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
        -- Rounds: those above their bound stop there, the others share what is left by weight.
        rounds AS (
            SELECT 0 AS n, (SELECT sum(source_size) FROM s) AS have, (SELECT sum(weight) FROM s) AS free, CAST(-1 AS DOUBLE) AS before, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) / (SELECT sum(weight) FROM s) AS rate
            UNION ALL
            SELECT n + 1, h, w, rate, CAST(h AS DOUBLE) / w FROM (
                SELECT n, rate, (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE 3 * source_size <= rate * weight), 0) AS h,
                       (SELECT sum(weight) FROM s WHERE 3 * source_size > rate * weight) AS w FROM rounds WHERE rate > before AND n < 1000)),
        t AS (SELECT s.*, least(3.0::DOUBLE * source_size, weight * (SELECT max(rate) FROM rounds)) AS target FROM s),
        p AS (SELECT doc_id, size, source_size, weight, target, CAST(round(target) AS BIGINT) AS demand,
                CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (demand // source_size) * size + greatest(0, least(demand % source_size - place, size)) END AS taken,
                CAST(place AS DOUBLE) / demand * weight AS area, weight * (1 - (weight - 2) / 2.0::DOUBLE) AS w0, weight * (weight - 2.0::DOUBLE) AS slope FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
               CASE WHEN taken > 0 THEN round(CASE WHEN area > 0 THEN 2 * area / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * area, 0))) ELSE 0 END, 9) END AS position FROM k
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
