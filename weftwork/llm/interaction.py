"""How filters interact: what each step of each order of filters removes, from one CUBE.

A document either fails a filter or not, whatever the order, so the documents that an order still has
after some steps are those that fail none of a set of filters. CUBE over the failure flags and the part
gives all these numbers at once: the grouping set of a set of flags has, in its row with all of them
false, the documents that survive the set. A step is a pair of sets, before and after, joined from there.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A word is a maximal run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that judge a text by itself: whether it fails. A: under 200 words, B: fewer distinct
    words than half, C: over 2 % capitals, D: special characters. Null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, own = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * own < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): documents counted by their flags. E: the text is that of a
    document with a smaller doc_id.

    A null source is the part ''; a row with a null doc_id has no smaller one, so never fails E, and has no
    labels. Repeated rows count each; of two with one doc_id and text neither fails E for the other. A
    doc_id with several labels is good or toxic if one of them says so. Extra columns are ignored.

    Texts never leave the scan: rows carry a 256-bit digest, and are joined with the least doc_id of each
    digest on both columns, so a group of very many copies is no key of the join.
    """
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"), *[c.alias(n) for n, c in text_flags(F.col("text")).items()])
    flags = ["A", "B", "C", "D"]
    own = own.groupBy("doc_id", "part", "digest", *flags).agg(F.count("*").alias("n"))
    least = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = own.join(least, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return rows.groupBy("part", *flags, late.alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def survivors(rows: DataFrame, filters: list[str]) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part, and of all (part null), fail none of
    the filters in ``mask`` (bit i: the i-th filter); sets that nothing survives are left out. ``rows``:
    flags, part, good, toxic and their number n, nulls nowhere."""
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    cube = rows.cube(*filters, "part").agg(F.sum("n").alias("n"), when("good").alias("good_"), when("toxic").alias("toxic_"), *[F.grouping(f).alias(f"_{f}") for f in filters])
    chosen = [F.col(f"_{f}") == 0 for f in filters]
    clean = [~on | ~F.col(f) for f, on in zip(filters, chosen)]
    mask = sum((F.when(on, 1 << i).otherwise(0) for i, on in enumerate(chosen)), F.lit(0))
    kept = clean[0]
    for c in clean[1:]:
        kept = kept & c
    return cube.where(kept).select("part", mask.cast("int").alias("mask"), "n", F.col("good_").alias("good"), F.col("toxic_").alias("toxic"))


def audit(rows: DataFrame, filters: list[str], whole: bool = False) -> DataFrame:
    """For each part, each order of ``filters`` and each step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removed documents summed over all orders). ``rows``: what
    ``flagged`` gives. With ``whole`` there are rows of a null part for all documents together. No
    documents give no rows. The orders are k! of k filters: meant for a handful.
    """
    spark, k = rows.sparkSession, len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    every, together = (1 << k) - 1, "" if all(len(f) == 1 for f in filters) else ">"
    # Read several times below: written once, a row a part and set.
    counts = materialize(survivors(rows, filters) if whole else survivors(rows, filters).where("part is not null"), "survivors")
    # Each part has all 2**k sets; those that nothing survives count zero. All joins below are on sets.
    masks = counts.where("mask = 0").select(F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(every))).alias("m"))
    found = masks.join(counts, masks.p.eqNullSafe(counts.part) & (masks.m == counts["mask"]), "left")
    sets = found.select(F.col("p").alias("part"), F.col("m").alias("mask"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    steps, pairs = [], {}
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            steps.append((together.join(order), i + 1, f, before))
            pairs[f, before] = factorial(i) * factorial(k - 1 - i)  # orders in which f comes right after this set
            before |= bit[f]
    pair = spark.createDataFrame([(f, b, b | bit[f], every & ~bit[f], w) for (f, b), w in pairs.items()], "filter string, before int, after int, others int, orders bigint")
    b, a = (sets.withColumnsRenamed({c: f"{x}_{c}" for c in sets.columns}) for x in "ba")
    both = b.join(pair, b.b_mask == pair.before).join(a, F.col("b_part").eqNullSafe(a.a_part) & (F.col("after") == a.a_mask))
    lost = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in ("n", "good", "toxic")}
    own = Window.partitionBy("b_part", "filter")  # 2**(k - 1) rows
    at = lambda c: F.sum(F.when(c, lost["n"]).otherwise(0)).over(own)
    rated = both.select(
        F.col("b_part").alias("part"), "filter", "before", F.col("a_n").alias("kept"), lost["n"].alias("removed"), (at(F.col("before") == 0) - lost["n"]).alias("redundant"),
        at(F.col("before") == F.col("others")).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.sum(F.col("orders") * lost["n"]).over(own).alias("shapley"))
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    return rated.join(plan, ["filter", "before"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
