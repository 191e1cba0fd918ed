"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

A source's weight is a schedule over training time from 0 to 1, linear between knots. Its integral says
which part of the source's demand is due by a time; the demand is the source's target of tokens, which
its documents, in the order of a hash and pass after pass, fill one after another. A pass of a document
begins where the demand of its source reaches the tokens before it: the schedule's integral is inverted
there, in closed form, and documents are sorted by these times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import materialize

#: A word is a maximal run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source whose running sums one task has; repeated rows one generator call makes.
BUCKET_ROWS, REPEAT_ROWS = 10_000, 10_000


def words(text: Column) -> Column:
    """The size of a text: its words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: sources share the sum of all sizes by
    weight, a target stops at ``most`` times its source's size, and what is over is shared again by
    weight among the others until no target is above.

    That ends where every target is the lesser of its bound and one common rate times its weight. Sources
    in order of bound by weight: those bounded come first, and running sums over that order tell where the
    bounds end. Weights are positive integers; a source of size 0 has target 0.
    """
    bound = (F.col("source_size") * most).cast("bigint")
    order = [F.try_divide(bound, F.col("weight")).asc(), F.col("source").asc_nulls_first()]
    ranked = numbered(sources, order, "_at", {"_bounds": bound, "_weights": F.col("weight")})
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_all"), F.coalesce(F.sum("weight"), F.lit(0)).alias("_every"))  # one row
    both = ranked.join(F.broadcast(total))
    # What is left for this source and those after it, if all before stop at their bounds.
    bounded = bound.cast("double") * (F.col("_every") - F.col("_weights")) <= (F.col("_all") - F.col("_bounds")).cast("double") * F.col("weight")
    marked = both.withColumn("_bounded", bounded)
    rate = marked.agg(
        (F.max("_all") - F.coalesce(F.sum(F.when(F.col("_bounded"), bound)), F.lit(0))).cast("double").alias("_left"),
        F.sum(F.when(~F.col("_bounded"), F.col("weight"))).cast("double").alias("_free"))
    share = F.col("weight") * F.try_divide("_left", "_free")
    target = F.when(F.col("_bounded"), bound.cast("double")).otherwise(F.least(bound.cast("double"), share))
    return marked.join(F.broadcast(rate)).select(*sources.columns, target.alias("target"))


def integrated(knots: Column) -> Column:
    """The segments of a schedule: an array of (t, span, weight, slope, before, area) from an array of
    knots (t, weight) in order of t; ``before`` is the integral up to the segment."""
    segment = lambda i: F.struct(
        F.get(knots, i)["t"].alias("t"), (F.get(knots, i + 1)["t"] - F.get(knots, i)["t"]).alias("span"), F.get(knots, i)["weight"].alias("weight"),
        ((F.get(knots, i + 1)["weight"] - F.get(knots, i)["weight"]) / (F.get(knots, i + 1)["t"] - F.get(knots, i)["t"])).alias("slope"),
        ((F.get(knots, i + 1)["weight"] + F.get(knots, i)["weight"]) * (F.get(knots, i + 1)["t"] - F.get(knots, i)["t"]) / 2).alias("area"))
    parts = F.transform(F.sequence(F.lit(0), F.size(knots) - 2), segment)
    before = lambda s, i: F.aggregate(F.slice(parts, 1, i), F.lit(0.0), lambda a, x: a + x["area"])
    return F.transform(parts, lambda s, i: F.struct(s["t"], s["span"], s["weight"], s["slope"], before(s, i).alias("before"), s["area"]))


def inverted(segments: Column, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a schedule's whole integral is due."""
    last = F.element_at(segments, -1)
    due = share * (last["before"] + last["area"])
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= due) & ((x["area"] > 0) | (x["before"] == 0))), -1)
    area = due - s["before"]
    # The root of weight * x + slope * x * x / 2 = area that does not lose digits where the slope is 0.
    x = F.try_divide(2 * area, s["weight"] + F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * s["slope"] * area, F.lit(0.0))))
    return s["t"] + F.when(area > 0, F.least(s["span"], x)).otherwise(0.0)


def mix(docs: DataFrame, schedule: Column, weight: Column, size: Column | None = None, most: int = 3) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, positions): each row of ``docs`` with the tokens
    that the mix takes of it and the times from 0 to 1 at which its passes begin; in order of the first.

    ``weight``: an integer column over ``rank``, the place of a source by code point from 0, null last.
    ``schedule``: an array of knots (t, weight as double) over ``rank``, from t 0 to 1, weights not
    negative and not all 0; its mean should be the source's weight, which alone decides how much is taken.
    ``size`` defaults to the words of ``text``. Taken tokens of a source add up to its rounded target: the
    document at which a pass ends is cut there. No document is taken more than ``most`` times.

    A null source is a source of its own; null and repeated doc_ids are rows of their own; a document of
    size 0 is taken 0 times; no rows give no rows; extra columns are ignored. Rows that agree in doc_id, source
    and size share what they get in some order. Reruns agree: documents lie in the order of the MD5 of their
    doc_id. A source of any size is cut into buckets of that order, whose sums are added up apart, so no
    source is in one task; nothing is broadcast but single rows.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), (words(F.col("text")) if size is None else size.cast("bigint")).alias("size"))
    rows = materialize(own, "sizes")
    buckets = rows.count() // BUCKET_ROWS + 1
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))
    # Rows that agree are one block, so that very many of them are no group of a window.
    blocks = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("digest", digest).withColumn("bucket", bucket)
    sums = blocks.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("inside"))
    sources = numbered(sums.groupBy("source").agg(F.sum("inside").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    wanted = targets(sources.withColumn("weight", weight.cast("bigint")), most).withColumn("segments", integrated(schedule))
    before = lambda w: F.coalesce(F.sum("inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("first", before(Window.partitionBy("source").orderBy("bucket"))).drop("inside")
    named = wanted.withColumnRenamed("source", "s")
    starts = starts.join(named, starts.source.eqNullSafe(named.s)).drop("s").withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_first(), "size")
    placed = blocks.withColumn("inside", F.col("size") * F.col("copies")).withColumn("inside", before(inside))
    joined = placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.bucket == starts.b))
    # Each copy is a row again, some thousands a step.
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n))
    stepped = joined.withColumn("step", many(F.floor((F.col("copies") - 1) / REPEAT_ROWS)))
    each = stepped.withColumn("copy", many(F.least(F.lit(REPEAT_ROWS), F.col("copies") - F.col("step") * REPEAT_ROWS) - 1))
    offset = F.col("first") + F.col("inside") + (F.col("step") * REPEAT_ROWS + F.col("copy")) * F.col("size")
    demand = F.round("target").cast("bigint")
    passes = F.expr("case when source_size > 0 then demand div source_size else 0L end")
    rest = F.col("demand") - F.col("passes") * F.col("source_size") - F.col("offset")
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    begins = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.try_divide("taken", "size")).cast("int")) - 1), lambda p: inverted(F.col("segments"), F.try_divide(F.col("offset") + p * F.col("source_size"), F.col("demand"))))
    out = each.withColumn("offset", offset).withColumn("demand", demand).withColumn("passes", passes).withColumn("taken", taken)
    out = out.withColumn("positions", F.when(F.col("taken") > 0, begins).otherwise(F.array().cast("array<double>")))
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", "positions").orderBy(first, F.col("doc_id"))


def training_order(mixed: DataFrame, most: int = 3) -> DataFrame:
    """(position, doc_id, pass, tokens): one row for each pass of a document, in order of training time;
    the last pass of a document may take a part of it. ``mixed``: what ``mix`` gives."""
    each = mixed.select("doc_id", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    tokens = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return each.select("position", "doc_id", "pass", tokens.alias("tokens")).orderBy("position", "doc_id", "pass")
