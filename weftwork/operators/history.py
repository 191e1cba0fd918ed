"""Results of earlier runs, found again by what their dependencies are now.

An entry is a result of a key under three versions, with the groups of dependencies it was made from and
the identity that each had. All entries of a key form a decision tree: a node asks for a group of keys, and
their identities lead to the next node or to a result. A node's name is the hash of the way to it, so a tree
is a plain table of nodes, trees merge by union, and a lookup is a walk by rounds of equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut, _union

#: What an entry is looked up by, besides the identities of its dependencies.
VERSIONED = ["key", "global_version", "builtin_version", "user_version"]
WORDS = 4


def _root() -> Column:
    return F.sha2(F.to_json(F.struct(*VERSIONED)), 256)


def _child(node: Column, depends: Column, identities: Column) -> Column:
    return F.sha2(F.concat(node, F.lit("\n"), F.to_json(depends), F.lit("\n"), F.to_json(identities)), 256)


def _groups(deps: DataFrame) -> DataFrame:
    """(entry, groups): the groups of each entry in order, each with its keys and identities in order."""
    one = deps.groupBy("entry", "group_no").agg(F.array_sort(F.collect_list(F.struct("pos", "dep", "identity"))).alias("g"))
    one = one.select("entry", F.struct("group_no", F.transform("g", lambda x: x["dep"]).alias("depends"), F.transform("g", lambda x: x["identity"]).alias("identities")).alias("g"))
    return one.groupBy("entry").agg(F.array_sort(F.collect_list("g")).alias("groups"))


def nested(entries: DataFrame, deps: DataFrame) -> DataFrame:
    """``entries`` (entry, key, the three versions, result) with ``groups`` (depends, identities), in order: the form
    that ``find`` takes."""
    known = entries.select("entry", *VERSIONED, "result").join(_groups(deps), "entry", "left")
    none = F.array().cast("array<struct<group_no:int,depends:array<string>,identities:array<string>>>")
    groups = F.transform(F.coalesce("groups", none), lambda g: F.struct(g["depends"].alias("depends"), g["identities"].alias("identities")))
    return known.withColumn("groups", groups)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row a node of (node, seq, depends, done): a result wins over questions and the first result over
    later ones; of different questions, which should not be, the latest."""
    ask, end = F.col("depends").isNotNull(), F.col("done").isNotNull()
    return rows.groupBy("node").agg(
        F.max_by(F.when(ask, F.col("depends")), F.when(ask, F.col("asked"))).alias("depends"), F.max(F.when(ask, F.col("asked"))).alias("asked"),
        F.min_by(F.when(end, F.col("done")), F.when(end, F.col("ended"))).alias("done"), F.min(F.when(end, F.col("ended"))).alias("ended"))


def tree(entries: DataFrame, deps: DataFrame) -> DataFrame:
    """(node, depends, asked, done, ended): the decision trees of all keys. ``entries``: (entry, key, the three
    versions, result), entry also their order in time; ``deps``: (entry, group_no, pos, dep, identity).

    Nodes are as many as entries have groups, and one more each. A key with very many entries is no group:
    nodes are made by each entry by itself and merged with partial aggregation. An entry without
    dependencies is a result at the root. Extra columns are ignored; no entries give no nodes.
    """
    way = F.aggregate("groups", F.array(_root()), lambda a, g: F.concat(a, F.array(_child(F.element_at(a, -1), g["depends"], g["identities"]))))
    ways = nested(entries, deps).withColumn("way", way)
    each = ways.select("entry", "result", "groups", F.posexplode("way").alias("i", "node"))
    last = F.col("i") == F.size("groups")
    return _nodes(each.select(
        "node", F.when(~last, F.get("groups", F.col("i"))["depends"]).alias("depends"), F.when(~last, F.col("entry")).alias("asked"),
        F.when(last, F.struct(F.col("result").cast("string").alias("result"), "entry")).alias("done"), F.when(last, F.col("entry")).alias("ended")))


def merge(*trees: DataFrame) -> DataFrame:
    """One tree of several: the same as the tree of all their entries, in any order."""
    return _nodes(_union([t.select("node", "depends", "asked", "done", "ended") for t in trees]))


def bloom(value: Column) -> list[Column]:
    """The words of a filter of one value: a bit in each, by a hash of its own."""
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(value, F.lit(i)), F.lit(64)).cast("int")) for i in range(1, WORDS + 1)]


def filters(entries: DataFrame, deps: DataFrame) -> DataFrame:
    """(key and versions, depends, b1..b4, open): for each key its first questions and a filter of the
    identities that some entry has for them. ``open`` keys cannot be ruled out by it: an entry has no
    dependencies, or entries differ in their first questions. Filters merge by ``merge_filters``."""
    first = _groups(deps).select("entry", F.get("groups", F.lit(0)).alias("g")).select("entry", F.col("g.depends").alias("depends"), F.to_json("g.identities").alias("own"))
    rows = entries.select("entry", *VERSIONED).join(first, "entry", "left")
    rows = rows.select(*VERSIONED, "depends", F.col("depends").isNull().alias("open"), *[F.when(F.col("own").isNotNull(), w).otherwise(F.lit(0)).cast("bigint").alias(f"b{i + 1}") for i, w in enumerate(bloom(F.col("own")))])
    return merge_filters(rows)


def merge_filters(*several: DataFrame) -> DataFrame:
    """One table of filters of several."""
    rows, words = _union(list(several)), [f"b{i + 1}" for i in range(WORDS)]
    differ = F.min("depends") != F.max("depends")
    return rows.groupBy(*VERSIONED).agg(F.max("depends").alias("depends"), (F.max("open") | F.coalesce(differ, F.lit(False))).alias("open"), *[F.bit_or(w).alias(w) for w in words])


def _identities(front: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """``front`` (by, depends) with the identities that all of ``depends`` have now; rows where one has none
    are left out."""
    asked = front.select(*by, "depends", F.posexplode("depends").alias("pos", "dep"))
    now = asked.join(current.select(F.col("key").alias("dep"), F.col("identity").alias("now")).where("now is not null"), "dep")
    grouped = now.groupBy(*by, "depends").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x["now"]).alias("identities"))
    return grouped.where(F.size("identities") == F.size("depends"))


def plausible(wanted: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (key and versions) that the filters do not rule out: some entry may have been made
    with the identities that its first dependencies have now. Never loses one that has."""
    words = [f"b{i + 1}" for i in range(WORDS)]
    both = wanted.select(*VERSIONED).join(known, VERSIONED)
    fits = F.lit(True)
    for w, own in zip(words, bloom(F.to_json("identities"))):
        fits = fits & (F.col(w).bitwiseOR(own) == F.col(w))
    tested = _identities(both.where("not open"), current, [*VERSIONED, *words]).where(fits)
    return both.where("open").select(*VERSIONED).union(tested.select(*VERSIONED))


def lookup(wanted: DataFrame, nodes: DataFrame, current: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key and versions, entry, result) of the keys of ``wanted`` that have a result under the same versions
    whose dependencies all have, group after group, the identity that ``current`` (key, identity) gives.

    Of a later group only keys still undecided ask; a key without an identity now, or a null one, fits
    nothing. With ``known`` (what ``filters`` gives) most keys that will find nothing never start. Rounds are as many
    as the longest entry has groups; each is written once. Wanted keys are distinct.
    """
    nodes = _cut(nodes.select("node", "depends", "done"))  # else a round would make the tree anew
    asked = wanted.select(*VERSIONED).distinct() if known is None else plausible(wanted.select(*VERSIONED).distinct(), known, current)
    front, done = asked.withColumn("node", _root()), []
    while True:
        here = _cut(front.join(nodes, "node"))
        done.append(here.where("done is not null").select(*VERSIONED, F.col("done.entry").alias("entry"), F.col("done.result").alias("result")))
        undecided = here.where("done is null")
        if undecided.isEmpty():
            return _union(done)
        step = _identities(undecided.select(*VERSIONED, "node", "depends"), current, [*VERSIONED, "node"])
        front = step.select(*VERSIONED, _child(F.col("node"), F.col("depends"), F.col("identities")).alias("node"))


def find(wanted: DataFrame, entries: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of ``lookup``, from the entries themselves (as ``nested`` gives them): of each wanted key's tree only the
    way that is walked is made, a node a round, and entries that are not below it are left out from there on.

    Rounds are as many as the longest entry has groups; each is written once. A key's entries are merged with partial
    aggregation, and lie together from the first round on.
    """
    columns, none = ["entry", "result", "groups"], F.array().cast("array<string>")
    left, done, depth = _cut(entries.join(wanted.select(*VERSIONED).distinct(), VERSIONED, "left_semi").select(*VERSIONED, *columns)), [], 0
    while True:
        group = F.get("groups", F.lit(depth))
        end = group.isNull()
        heads = _cut(left.groupBy(*VERSIONED).agg(
            F.min(F.when(end, F.struct("entry", F.col("result").cast("string").alias("result")))).alias("done"), F.max_by(F.when(~end, group["depends"]), F.when(~end, F.col("entry"))).alias("depends")))
        done.append(heads.where("done is not null").select(*VERSIONED, "done.entry", "done.result"))
        undecided = heads.where("done is null")
        if undecided.isEmpty():
            return _union(done)
        step = _identities(undecided.select(*VERSIONED, "depends"), current, VERSIONED)
        below = left.withColumns({"own_depends": F.coalesce(group["depends"], none), "own": F.coalesce(group["identities"], none)}).join(step, VERSIONED)
        left, depth = _cut(below.where("own_depends = depends and own = identities").select(*VERSIONED, *columns)), depth + 1
