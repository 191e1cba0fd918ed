"""Operators over dependency graphs; edges are (src, group_no, dst): src depends on dst.

Iterations write each round to the session's shared checkpoint folder, so plans stay short and lost
executors cost one round. Levels and paths first shorten chains: a node with one dependency points to
it, and pointers double their reach each round; what is left are rounds over the depth of nodes with several
dependencies. Closure and liveness advance a frontier by one level a round.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder; only where none is set and the
    master is local (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'weftwork-graph')}"


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut, and its size is known to what
    is planned with it (a checkpoint would carry estimates on, which grow with every round)."""
    path = f"{_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How many times its size on disk a table of rounds may take in memory: columns that are alike take nearly nothing there.
PACKED = 32


@contextmanager
def _no_large_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, tables are taken to be PACKED times as large as their files when joins are planned. Else one of millions
    of rows that packs well passes for small, and the driver makes a broadcast of it; what is small once it is read is
    still found out then."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(float(before), float(PACKED))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _union(parts: list[DataFrame]) -> DataFrame:
    """The rounds' tables together; none is written again."""
    return reduce(DataFrame.union, parts)


class CycleError(ValueError):
    """Some nodes depend on themselves; ``some`` names at most ten of them."""

    def __init__(self, some: list):
        super().__init__(f"{len(some)} or more nodes are on or behind a cycle, such as {some}")
        self.some = some


def _chains(weights: DataFrame, spans: DataFrame, nodes: int) -> DataFrame:
    """(index, to, sum) of the nodes with one dependency: where the chain of such nodes ends, and the weights of
    its nodes up to there."""
    single = spans.where("least = most").select("index", F.col("least").alias("to"))
    now, reach = _cut(single.join(weights, "index").select("index", "to", F.col("w").alias("sum"))), 1
    while True:
        further = now.select(F.col("index").alias("to"), F.col("to").alias("next"), F.col("sum").alias("more"))
        moved = _cut(now.join(further, "to", "left"))
        open_ = moved.where("next is not null")
        if open_.isEmpty():
            return now
        if reach > nodes:
            raise CycleError([r["index"] for r in open_.limit(10).collect()])
        now, reach = _cut(moved.select("index", F.coalesce("next", "to").alias("to"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"))), reach * 2


def _spans(pairs: DataFrame) -> DataFrame:
    """(index, least, most) of each node with dependencies: they are one if both are equal."""
    return pairs.groupBy(F.col("src").alias("index")).agg(F.min("dst").alias("least"), F.max("dst").alias("most"))


def longest(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, value): the weight of each node and the greatest value of its dependencies. ``weights``: (index, w)
    of all nodes that edges name. Repeated edges change nothing. Raises CycleError for graphs that are not acyclic."""
    pairs = _cut(edges.select("src", "dst"))
    return _longest(_cut(weights.select("index", "w")), pairs, _cut(_spans(pairs)))


def _longest(weights: DataFrame, pairs: DataFrame, spans: DataFrame) -> DataFrame:
    chains = _chains(weights, spans, weights.count())
    ends = chains.select(F.col("index").alias("dst"), "to", "sum")
    # Nodes with several dependencies, and where the chains that begin at those end.
    branching = pairs.join(chains.select(F.col("index").alias("src")), "src", "left_anti")
    shortened = branching.join(ends, "dst", "left")
    waiting = _cut(shortened.groupBy("src", F.coalesce("to", "dst").alias("at")).agg(F.max(F.coalesce("sum", F.lit(0))).alias("sum")))
    leaves = weights.join(spans, "index", "left_anti")
    ready = _cut(leaves.select("index", F.col("w").alias("value")))
    done, some = [ready], None
    left = not waiting.isEmpty()
    while left:
        met = waiting.join(ready.withColumnsRenamed({"index": "at"}), "at", "left")
        arrived = met.select(F.col("src").alias("index"), (F.col("sum") + F.col("value")).alias("value"), F.col("value").isNull().alias("waits"))
        rows = arrived if some is None else arrived.union(some.withColumn("waits", F.lit(False)))
        best = _cut(rows.groupBy("index").agg(F.max("value").alias("value"), F.max("waits").alias("waits")))
        ready = _cut(best.where("not waits").join(weights, "index").select("index", (F.col("value") + F.col("w")).alias("value")))
        still = best.where("waits")
        left = not still.isEmpty()
        if left and ready.isEmpty():
            raise CycleError([r["index"] for r in still.limit(10).collect()])
        if left:  # the last round needs no table of what is left
            waiting = _cut(met.where("value is null").select("src", "at", "sum"))
        some = still.where("value is not null").select("index", "value")
        done.append(ready)
    known = _union(done)
    return known.union(chains.join(known.select(F.col("index").alias("to"), "value"), "to").select("index", F.col("sum") + F.col("value")))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, level): 0 without dependencies, else 1 + the greatest level of any dependency. Repeated edges
    change nothing. Raises CycleError for graphs that are not acyclic."""
    pairs = _cut(edges.select("src", "dst"))
    spans = _cut(_spans(pairs))
    # Sources are no names that only edges have: spans has them already.
    named = nodes.select("index").union(pairs.select("dst")).repartition("index").distinct()
    weights = named.join(spans.select("index", F.lit(1).alias("w")), "index", "full_outer").select("index", F.coalesce("w", F.lit(0)).alias("w"))
    return _longest(_cut(weights), pairs, spans).select("index", F.col("value").cast("int").alias("level"))


#: Up to this depth critical paths take a round a level, which adds seconds from the leaves up.
ROUNDS = 32


def critical_path(nodes: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(index, level, path): seconds of the longest chain of dependencies that ends with each node,
    groups left aside. ``ranked``: what ``levels`` gives. In deep graphs seconds are added up by chains, in
    another order, so the last digit may differ from an addition from the leaves up."""
    deepest = ranked.agg(F.max("level")).first()[0] or 0
    if deepest > ROUNDS:
        paths = longest(nodes.select("index", F.col("execution").alias("w")), edges)
        return ranked.join(paths, "index").select("index", "level", F.col("value").alias("path"))
    rows = _cut(nodes.select("index", "execution").join(ranked, "index"))
    pairs = _cut(edges.select("src", "dst").join(rows.select(F.col("index").alias("src"), "level"), "src"))
    done = [_cut(rows.where("level = 0").select("index", "level", F.col("execution").alias("path")))]
    for level in range(1, deepest + 1):
        paths = _union(done).select(F.col("index").alias("dst"), "path")
        before = pairs.where(F.col("level") == level).join(paths, "dst").groupBy(F.col("src").alias("index")).agg(F.max("path").alias("before"))
        now = rows.where(F.col("level") == level).join(before, "index")
        done.append(_cut(now.select("index", "level", (F.col("before") + F.col("execution")).alias("path"))))
    return _union(done)


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, index, hops): everything that each root (a column ``index``) depends on, with the
    fewest hops to it; each node once a root. A round's step reads only the edges of nodes of its front; edges of
    nodes that nothing uses are read in the first round alone."""
    pairs = _cut(edges.select("src", "dst"))
    seen, first = [_cut(roots.select(F.col("index").alias("root"), "index").distinct().withColumn("hops", F.lit(0)))], True
    while not seen[-1].isEmpty():
        if first:
            own = pairs.join(seen[0].select(F.col("index").alias("src")), "src", "left_semi")
        else:
            front = _cut(seen[-1].select(F.col("index").alias("src")).distinct())
            own = _cut(pairs.join(front, "src", "left_semi").distinct())
        step = seen[-1].join(own.withColumnRenamed("src", "at"), F.col("index") == F.col("at")).select("root", F.col("dst").alias("index"))
        step = step.repartition("root", "index").distinct()
        fresh = step.join(_union(seen).select("root", "index"), ["root", "index"], "left_anti")
        seen.append(_cut(fresh.withColumn("hops", F.lit(len(seen)))))
        if first:
            used = pairs.select(F.col("dst").alias("src")).repartition("src").distinct()
            pairs, first = _cut(pairs.join(used, "src", "left_semi")), False
    return _union(seen).where("hops > 0")


def live(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(index): the roots and all that they depend on. One frontier of nodes: no root is kept, and repeated edges
    change nothing."""
    pairs = _cut(edges.select("src", "dst"))
    seen = [_cut(roots.select("index").distinct())]
    while not seen[-1].isEmpty():
        step = pairs.join(seen[-1], pairs.src == seen[-1]["index"], "left_semi").select(F.col("dst").alias("index")).repartition("index").distinct()
        seen.append(_cut(step.join(_union(seen), "index", "left_anti")))
    return _union(seen)


def deepest_chain(edges: DataFrame, ranked: DataFrame, start: int) -> list[int]:
    """The chain from ``start`` to a leaf that always takes the deepest dependency, the least index
    of equal ones. Its length is the depth of the graph: all that comes to the driver. Steps double."""
    rank = ranked.select(F.col("index").alias("dst"), "level")
    deepest = F.max_by("dst", F.struct("level", -F.col("dst")))
    step = _cut(edges.select("src", "dst").distinct().join(rank, "dst").groupBy("src").agg(deepest.alias("to")))
    seen = _cut(ranked.where(F.col("index") == start).select("index"))
    while True:
        moved = _cut(seen.join(step, seen["index"] == step.src).select(F.col("to").alias("index")))
        if moved.isEmpty():
            break
        seen = _cut(seen.union(moved))
        far = step.select(F.col("src").alias("to"), F.col("to").alias("next"))
        step = _cut(step.join(far, "to").select("src", F.col("next").alias("to")))
    return [r["index"] for r in ranked.join(seen, "index", "left_semi").orderBy(F.col("level").desc()).collect()]


def flatten_depends(lists: DataFrame) -> DataFrame:
    """Merges parallel lists of groups: (src, list, group_no, pos, dst) to (src, group_no, pos,
    dst), where the n-th groups of all lists become the n-th group, and each dst stays only where
    it comes first; groups that become empty close up."""
    from pyspark.sql import Window

    first = lists.groupBy("src", "dst").agg(F.min(F.struct("group_no", "list", "pos")).alias("at"))
    groups = F.dense_rank().over(Window.partitionBy("src").orderBy("at.group_no")) - 1
    pos = F.row_number().over(Window.partitionBy("src", "at.group_no").orderBy("at.list", "at.pos")) - 1
    return first.select("src", groups.alias("group_no"), pos.alias("pos"), "dst")
