"""Whether one node is behind another, from an index of a few numbers a node instead of a closure.

Each node hangs below one of its users in a spanning forest. In the forest's preorder a subtree is an
interval, so an ancestor's interval holding a node's number proves that the node is behind it. A second interval
holds the numbers of all that a node can reach at all, so a number outside of it proves the contrary.
Pairs in between are followed along dependencies until one of the two settles them. Subtree sizes and
numbers come from pointers that double their reach each round, so a deep tree takes few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut, _union
from .ordering import numbered


def _forest(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(index, parent): the least user of each node; null for those that nothing uses."""
    users = pairs.groupBy(F.col("dst").alias("index")).agg(F.min("src").alias("parent"))
    return nodes.select("index").distinct().join(users, "index", "left")


def _sizes(forest: DataFrame) -> DataFrame:
    """(index, parent, size): nodes of each subtree. After k rounds a node knows those less than 2**k below it
    and its ancestor 2**k above, which it adds its own count to."""
    now = _cut(forest.select("index", "parent", F.col("parent").alias("above"), F.lit(1).cast("bigint").alias("size")))
    while not now.where("above is not null").isEmpty():
        own = now.select(F.col("index").alias("above"), F.col("above").alias("next"))
        more = now.where("above is not null").groupBy(F.col("above").alias("index")).agg(F.sum("size").alias("more"))
        moved = now.join(own, "above", "left").join(more, "index", "left")
        now = _cut(moved.select("index", "parent", F.col("next").alias("above"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return now.select("index", "parent", "size")


def _starts(sized: DataFrame) -> DataFrame:
    """(index, start, end): preorder numbers. Among the children of a node, and among the roots, the sizes of
    those before are added up over one sorted table, so a node may have any number of children."""
    placed = numbered(sized, [F.col("parent").asc_nulls_first(), F.col("index")], "_at", {"before": F.col("size")})
    first = placed.where("parent is not null").groupBy("parent").agg(F.min("before").alias("least"))
    steps = placed.join(first, "parent", "left").select("index", "size", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), F.col("before")).otherwise(F.col("before") - F.col("least") + 1).alias("start"))
    now = _cut(steps)
    while not now.where("above is not null").isEmpty():
        up = now.select(F.col("index").alias("above"), F.col("above").alias("next"), F.col("start").alias("more"))
        now = _cut(now.join(up, "above", "left").select("index", "size", F.col("next").alias("above"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")))
    return now.select("index", "start", (F.col("start") + F.col("size") - 1).alias("end"))


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, start, end, low, high): the index. ``edges`` (src, dst) are acyclic: src uses dst; nodes that only
    edges name are left out. A row a node, whatever the graph; the intervals low to high hold the numbers of all that is
    behind a node (null: nothing), not its own, and spread by one edge a round until none grows."""
    pairs = _cut(edges.select("src", "dst").repartition("src").distinct())
    own = _starts(_sizes(_forest(nodes, pairs)))
    none = F.lit(None).cast("bigint")
    now = _cut(own.withColumns({"low": none, "high": none, "grew": F.lit(True)}))
    while not now.where("grew").isEmpty():
        low, high = F.least("start", "low"), F.greatest("end", "high")  # nulls are passed over
        grown = now.where("grew").select(F.col("index").alias("dst"), low.alias("low"), high.alias("high"))
        spread = pairs.join(grown, "dst").groupBy(F.col("src").alias("index")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        low, high = F.least("low", "l"), F.greatest("high", "h")
        grew = ~low.eqNullSafe(F.col("low")) | ~high.eqNullSafe(F.col("high"))
        now = _cut(now.join(spread, "index", "left").select("index", "start", "end", low.alias("low"), high.alias("high"), grew.alias("grew")))
    return now.select("index", "start", "end", "low", "high")


def _asked(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows (src, dst) of ``pairs`` whose dst ``targets`` (dst, ...) has, each once, with the other columns of
    ``targets``; dealt by src, so that what is joined by src takes no further shuffle. Only the targets that are asked
    for are joined: many pairs may ask for few."""
    few = _cut(targets.join(pairs.select("dst").distinct(), "dst", "left_semi"))
    return pairs.select("src", "dst").where("src <> dst").repartition("src").distinct().join(few, "dst")


def _behind(asked: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
    """``behind`` for distinct pairs with the number of dst. Dependencies carry the intervals of what they lead to, so what
    cannot lead to dst is dropped where it is met, before it is shuffled or written."""
    known = index.select(F.col("index").alias("at"), "start", "end", "low", "high")
    inside, may = F.col("number").between(F.col("start"), F.col("end")), F.col("number").between(F.col("low"), F.col("high"))
    begun = asked.withColumn("at", F.col("src")).join(known, "at")
    here = _cut(begun.where(inside | may).select("src", "dst", "number", "at", inside.alias("yes")))
    proved, steps = [here.where("yes").select("src", "dst")], None
    front = here.where("not yes")
    while not front.isEmpty():
        if steps is None:
            leads = known.withColumnRenamed("at", "next")
            steps = _cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).join(leads, "next"))
        met = front.select("src", "dst", "number", "at").join(steps, "at").where(inside | may)
        here = _cut(met.select("src", "dst", "number", F.col("next").alias("at"), F.coalesce(inside, F.lit(False)).alias("yes")).distinct())
        found = here.where("yes").select("src", "dst").distinct()
        proved.append(found)
        front = _cut(here.where("not yes").join(found, ["src", "dst"], "left_anti"))
    return _union(proved)


def _numbers(index: DataFrame) -> DataFrame:
    return index.select(F.col("index").alias("dst"), F.col("start").alias("number"))


def behind(pairs: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (src, dst) of ``pairs``, each once, where src uses dst directly or by others. ``index``: what
    ``labels`` gives for ``edges``. A node is not behind itself; pairs with unknown nodes are not."""
    return _behind(_asked(pairs, _numbers(index)), index, edges)


def not_declared(used: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst) that src was found to use although dst is made from something itself and is not behind src:
    it might not have been made yet."""
    made = edges.select(F.col("src").alias("dst")).distinct()
    asked = _cut(_asked(used, made.join(_numbers(index), "dst", "left")))
    proved = _behind(asked.where("number is not null"), index, edges)
    return asked.select("src", "dst").join(proved, ["src", "dst"], "left_anti")
