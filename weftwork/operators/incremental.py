"""Incremental evaluation of keyed results: dirty checks, early cutoff, modes, history, logs.

Results are (id, digest, built, changed); an edge (src, dst) says src used dst when it was built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut, _union


def dirty(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of results that a dependency outdates: one that changed after they were built."""
    me, dep = results.select("id", "built"), results.select(F.col("id").alias("dst"), F.col("changed").alias("dep_changed"))
    used = edges.select(F.col("src").alias("id"), "dst").join(dep, "dst")
    return me.join(used, (me.id == used.id) & (used.dep_changed > me.built), "left_semi").select("id")


def need_has_changed(built: DataFrame, edges: DataFrame, now: DataFrame) -> DataFrame:
    """(src, dst) of dependencies that changed since src was built; all, if src never was.
    ``built`` holds the results of the sources, ``now`` those of the dependencies."""
    me, dep = built.select(F.col("id").alias("src"), "built"), now.select(F.col("id").alias("dst"), F.col("changed").alias("dep_changed"))
    return edges.join(dep, "dst").join(me, "src", "left").where(F.coalesce(F.col("dep_changed") > F.col("built"), F.lit(True))).select("src", "dst")


def cutoff(new: DataFrame, old: DataFrame, step: int) -> DataFrame:
    """The results after a run: built now, changed only where the digest is new."""
    o = old.select("id", F.col("digest").alias("old_digest"), F.col("changed").alias("old_changed"))
    same = F.col("digest") == F.col("old_digest")
    return new.join(o, "id", "left").select("id", "digest", F.lit(step).cast("bigint").alias("built"), F.when(same, F.col("old_changed")).otherwise(F.lit(step)).cast("bigint").alias("changed"), F.when(same, "RecomputeSame").otherwise("RecomputeDiff").alias("kind"))


def evaluate(results: DataFrame, edges: DataFrame, sources: DataFrame, rule: Callable[[DataFrame], DataFrame], ranked: DataFrame, step: int) -> DataFrame:
    """One incremental run: (id, digest, built, changed) of all nodes of ``ranked`` (index, level).

    ``sources``: (id, digest) of the leaves as they are now. ``rule`` maps (id, deps array of
    digests ordered by dst) to (id, digest). Level by level, a node is computed if it has no result,
    its source differs, or a dependency changed after it was built; else it is left alone. A result
    with the digest of before keeps ``changed``, which cuts off what depends on it.
    """
    depth = ranked.agg(F.max("level")).first()[0] or 0
    pairs = edges.select(F.col("src").alias("id"), "dst").repartition("id").distinct()
    pairs = _cut(pairs.join(ranked.select(F.col("index").alias("id"), "level"), "id"))
    old = results.select("id", F.col("digest").alias("old_digest"), F.col("built").alias("old_built"), F.col("changed").alias("old_changed"))
    done: list[DataFrame] = []
    for level in range(depth + 1):
        nodes = ranked.where(F.col("level") == level).select(F.col("index").alias("id")).join(old, "id", "left")
        if level == 0:
            fresh = nodes.join(sources, "id", "left")
            need = F.col("old_built").isNull() | (F.col("digest") != F.col("old_digest"))
        else:
            used = pairs.where(F.col("level") == level).select("id", "dst").join(_union(done).select(F.col("id").alias("dst"), F.col("digest").alias("d"), F.col("changed").alias("c")), "dst")
            deps = used.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "d"))), lambda x: x["d"]).alias("deps"), F.max("c").alias("latest"))
            state = nodes.join(deps, "id")
            need = F.col("old_built").isNull() | (F.col("latest") > F.col("old_built"))
            fresh = state.where(need).select("id").join(rule(state.where(need).select("id", "deps")), "id")
            fresh = state.join(fresh, "id", "left")
        changed = F.when(need & (F.col("digest") != F.coalesce("old_digest", F.lit(""))), step).otherwise(F.coalesce("old_changed", F.lit(step)))
        rows = fresh.select("id", F.when(need, F.col("digest")).otherwise(F.col("old_digest")).alias("digest"), F.when(need, step).otherwise(F.col("old_built")).cast("bigint").alias("built"), changed.cast("bigint").alias("changed"))
        done.append(_cut(rows))
    return _union(done)


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last record of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return newest.select(key, *[F.col("r")[c].alias(c) for c in rest])


def compaction_due(log: DataFrame, key: str = "id") -> DataFrame:
    """One row: records, distinct keys, and whether the log is over twice as long as it need be."""
    return log.agg(F.count("*").alias("records"), F.count_distinct(key).alias("keys")).withColumn("due", F.col("records") > 2 * F.col("keys"))


def compact(log: DataFrame, path: str, key: str = "id", order: str = "seq") -> None:
    """Writes the latest records to a new directory."""
    latest(log, key, order).write.mode("errorifexists").parquet(path)


def file_equality(mode: str, mod_same, size_same, hash_same):
    """'cheap', 'expensive' or 'ne': how two file states compare under a mode. Missing values equal
    nothing; pass columns of booleans."""
    mod_same, size_same, hash_same = (F.coalesce(x, F.lit(False)) for x in (mod_same, size_same, hash_same))
    digest = size_same & hash_same
    if mode == "modtime":
        return F.when(mod_same, "cheap").otherwise("ne")
    if mode == "digest":
        return F.when(digest, "expensive").otherwise("ne")
    if mode in ("modtime_and_digest", "modtime_and_digest_input"):
        return F.when(mod_same, "cheap").when(digest, "expensive").otherwise("ne")
    if mode == "modtime_or_digest":
        return F.when(mod_same & digest, "expensive").otherwise("ne")
    raise ValueError(f"no such mode: {mode}")


def rebuild_mode(entries: list[tuple[str, str]], name, test):
    """The mode of the last entry (mode, pattern) that matches a name, else 'normal'."""
    out = F.lit("normal")
    for mode, pattern in entries:
        out = F.when(test(pattern, name), mode).otherwise(out)
    return out


def pick_rule(candidates: DataFrame) -> DataFrame:
    """(key, rule, candidates): of (key, rule, priority) those of each key's highest priority;
    rule is null if several share it, which is an error."""
    best = candidates.groupBy("key").agg(F.max("priority").alias("priority"))
    top = candidates.join(best, ["key", "priority"]).groupBy("key").agg(F.count("*").alias("candidates"), F.min("rule").alias("rule"))
    return top.select("key", F.when(F.col("candidates") == 1, F.col("rule")).alias("rule"), "candidates")


def history_hits(entries: DataFrame, deps: DataFrame, current: DataFrame) -> DataFrame:
    """(entry) all of whose recorded dependencies (entry, key, identity) have the identity that
    ``current`` (key, identity) gives now; entries without dependencies fit."""
    now = current.select("key", F.col("identity").alias("now"))
    unfit = deps.join(now, "key", "left").where(~F.col("identity").eqNullSafe(F.col("now"))).select("entry").distinct()
    return entries.select("entry").join(unfit, "entry", "left_anti")


def used_not_declared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, key) that a rule used but did not declare as a dependency."""
    return used.select("id", "key").distinct().join(declared.select("id", "key"), ["id", "key"], "left_anti")


def used_too_early(used: DataFrame, declared: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, key) used without declaration though the key is itself something with dependencies."""
    return used_not_declared(used, declared).join(edges.select(F.col("src").alias("key")).distinct(), "key", "left_semi").select("id", "key")


def declared_absent(promised: DataFrame, existing: DataFrame) -> DataFrame:
    """(key) that were promised not to exist, but do."""
    return promised.select("key").distinct().join(existing.select("key"), "key", "left_semi")


def watch_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two listings (path, digest): Created, Deleted or Changed."""
    b, a = before.select("path", F.col("digest").alias("b"), F.lit(True).alias("was")), after.select("path", F.col("digest").alias("a"), F.lit(True).alias("is_now"))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "Created").when(F.col("is_now").isNull(), "Deleted").when(~F.col("a").eqNullSafe(F.col("b")), "Changed")
    return both.select("path", change.alias("change")).where("change is not null")


def progress_fold(status: DataFrame) -> DataFrame:
    """One row of progress counters from (status, step_built, step, execution): what is skipped,
    built, unknown and still to do; seconds known and how many are unknown."""
    s, e = F.col("status"), F.col("execution")
    ready_now = (s == "Ready") & (F.col("built") == F.col("step"))
    ready_old = (s == "Ready") & (F.col("built") != F.col("step"))
    todo_known, todo_unknown = (s == "Running") & e.isNotNull(), (s == "Running") & e.isNull()
    count, total = lambda c: F.count(F.when(c, 1)), lambda c: F.coalesce(F.sum(F.when(c, e)), F.lit(0.0))
    return status.agg(
        count(ready_old).alias("count_skipped"), count(ready_now).alias("count_built"), count(s == "Loaded").alias("count_unknown"), count(s == "Running").alias("count_todo"),
        total(ready_old).alias("time_skipped"), total(ready_now).alias("time_built"), total(s == "Loaded").alias("time_unknown"), total(todo_known).alias("time_todo"), count(todo_unknown).alias("todo_without_time"))


def batches(keys: DataFrame, size: int, by: str) -> DataFrame:
    """Numbers the keys of each ``by`` into batches of ``size``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy("key")) - 1
    return keys.withColumn("batch", F.floor(n / size).cast("bigint"))
