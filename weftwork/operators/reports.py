"""Reports over profiles: every one is a function from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def untraced():
    """Seconds of a rule outside its traced commands, never below 0."""
    return F.greatest(F.lit(0.0), F.col("execution") - F.aggregate("traces", F.lit(0.0), lambda a, t: a + t["stop"] - t["start"]))


def rule_table(found: DataFrame) -> DataFrame:
    """Per group: count, leaf, run, changed, time and untraced time."""
    return found.groupBy("group").agg(
        F.count("*").alias("count"), F.bool_and(F.size("depends") == 0).alias("leaf"), F.min("built").alias("run"), F.bool_or(F.col("changed") == F.col("built")).alias("changed"),
        F.sum("execution").alias("time"), F.sum(untraced()).alias("untraced"))


def command_table(traces: DataFrame) -> DataFrame:
    """Per command: count, total, longest and average seconds; empty commands mark a run's end."""
    spent = F.col("stop") - F.col("start")
    return traces.where("command <> ''").groupBy("command").agg(F.count("*").alias("count"), F.sum(spent).alias("total"), F.max(spent).alias("max"), F.avg(spent).alias("average"))


def run_ends(profile: DataFrame) -> DataFrame:
    """Per run: when its last trace stopped; rows whose only trace is a marker are left out."""
    kept = profile.where((F.size("traces") > 0) & ~((F.size("traces") == 1) & (F.get("traces", F.lit(0))["command"] == "")))
    return kept.groupBy("built").agg(F.max(F.try_element_at("traces", F.lit(-1))["stop"]).alias("end"))


def summary(nodes: DataFrame, traces: DataFrame) -> DataFrame:
    """One row of totals: runs, rules, rules of the last run, seconds of work in all and in the last
    run, traces and their seconds in all and in the last run, the last stop of a trace of the last
    run, and that run's parallelism by rules and by traces. ``traces`` has the ``index`` of its node."""
    last = traces.join(nodes.where("built = 0").select("index"), "index", "left_semi")
    n = nodes.agg((F.max("changed") + 1).alias("runs"), F.count("*").alias("rules"), F.count(F.when(F.col("built") == 0, 1)).alias("rules_last"), F.sum("execution").alias("work"), F.sum(F.when(F.col("built") == 0, F.col("execution"))).alias("work_last"))
    spent = F.sum(F.col("stop") - F.col("start"))
    t = traces.agg((F.count("*") - 1).alias("traced"), spent.alias("traced_time"))
    own = last.agg(F.count("*").alias("traced_last"), spent.alias("traced_time_last"), F.max("stop").alias("end"))
    ratio = lambda x: F.coalesce(F.try_divide(x, "end"), F.lit(0.0))
    return n.crossJoin(t).crossJoin(own).select("*", ratio("work_last").alias("parallelism"), ratio("traced_time_last").alias("trace_parallelism"))  # three single rows


def timeline(traces: DataFrame, end: float, buckets: int = 100) -> DataFrame:
    """Per command and bucket: how many of it ran on average; buckets without any are 0. A trace
    spreads over the buckets that it overlaps; what lies at or beyond ``end`` is cut off."""
    scale = buckets / end
    a, b = F.col("start") * scale, F.col("stop") * scale
    first, last = F.greatest(F.floor(a), F.lit(0)), F.least(F.floor(b), F.lit(buckets - 1))
    spread = traces.where((first < buckets) & (last >= first)).select("command", a.alias("a"), b.alias("b"), F.explode(F.sequence(first, last)).alias("bucket"))
    share = F.greatest(F.lit(0.0), F.least("b", F.col("bucket") + 1) - F.greatest("a", F.col("bucket").cast("double")))
    filled = spread.groupBy("command", "bucket").agg(F.sum(share).alias("value"))
    every = traces.select("command").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    return every.join(filled, ["command", "bucket"], "left").select("command", "bucket", F.coalesce("value", F.lit(0.0)).alias("value"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(index, src): each node with one that depends on it; a hub's users stay rows. Rows are dealt by node first: in
    the order of a scan there is little to merge, and a task's map of all its rows would grow with the table."""
    return edges.select(F.col("dst").alias("index"), "src").repartition("index").distinct()


def users(edges: DataFrame) -> DataFrame:
    """Per node: how many depend on it, the first and the last of them."""
    return reverse_edges(edges).groupBy("index").agg(F.count("*").alias("users"), F.min("src").alias("first"), F.max("src").alias("last"))


def dependency_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both names."""
    a, b = nodes.select(F.col("index").alias("src"), F.col("name").alias("name")), nodes.select(F.col("index").alias("dst"), F.col("name").alias("needs"))
    return edges.join(a, "src").join(b, "dst").select("name", "group_no", "needs")


def step_ranks(results: DataFrame) -> DataFrame:
    """Runs ago of every step that built or changed something: a dense rank, 0 the newest. Steps
    are few, however many results there are."""
    steps = results.select(F.col("built").alias("step")).union(results.select("changed")).distinct()
    return steps.select("step", (F.dense_rank().over(Window.orderBy(F.col("step").desc())) - 1).alias("runs_ago"))


def longest(rows: DataFrame, name: str, seconds: str) -> DataFrame:
    """The longest row; of equal ones the later index."""
    return rows.agg(F.max_by(name, F.struct(seconds, "index")).alias("name"), F.max(seconds).alias("seconds"))


def weighted_average(w1, x1, w2, x2):
    """(w1 x1 + w2 x2) / (w1 + w2); 0 if both weights are; a value of weight 0 does not count."""
    part = lambda w, x: F.when(w == 0, F.lit(0.0)).otherwise(w * x)
    return F.when((w1 == 0) & (w2 == 0), F.lit(0.0)).otherwise((part(w1, x1) + part(w2, x2)) / F.nullif(w1 + w2, F.lit(0)))


def phases(instants: DataFrame, key: str) -> DataFrame:
    """Seconds from each instant to the next of its key, and their share of the whole in percent."""
    order = Window.partitionBy(key).orderBy("t", "label")
    spent = F.lead("t").over(order) - F.col("t")
    with_next = instants.withColumn("seconds", spent).where("seconds is not null")
    total = F.sum("seconds").over(Window.partitionBy(key))
    return with_next.withColumn("percent", F.coalesce(F.try_divide(F.col("seconds") * 100, total), F.lit(0.0)))


def concurrency(traces: DataFrame, key: str) -> DataFrame:
    """Per key: the most traces that ran at once; one that stops as another starts is over."""
    events = traces.select(key, F.col("start").alias("t"), F.lit(1).alias("d")).union(traces.select(key, "stop", F.lit(-1)))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("running", running).groupBy(key).agg(F.max("running").alias("peak"))


def error_levels(errors: DataFrame, key: str, levels=(100, 90, 80, 50)) -> DataFrame:
    """Per key and level L: the bound within which the smallest L percent of the errors lie.

    Bounds are whole numbers, so errors are first counted by the whole number above them: ranks then
    come from as many rows as there are such numbers, however many errors share one. Null errors are
    the least, and the bound of nulls alone is null."""
    counted = errors.groupBy(key, F.ceil("error").cast("bigint").alias("within")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("within").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    spread = ranked.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("wanted", F.floor(F.col("total") * F.col("level") / 100))
    return spread.where((F.col("wanted") > 0) & (F.col("upto") - F.col("n") < F.col("wanted"))).groupBy(key, "level").agg(F.max("within").alias("within"))


def rule_times(profile: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Per group of found rows (index, group): exclusive and weighted time, from the starts that
    ``simulation.starts`` gives for 24 threads."""
    timed = exclusive_time(starts, key)
    return profile.select("index", "group").join(timed, "index").groupBy("group").agg(F.sum("etime").alias("etime"), F.sum("wtime").alias("wtime"))


def counters(profile: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows found, of how many, and in how many groups."""
    return found.agg(F.count("*").alias("found"), F.count_distinct("group").alias("groups")).crossJoin(profile.agg(F.count("*").alias("total")))  # single rows


def exclusive_time(starts: DataFrame, key: str) -> DataFrame:
    """Exclusive-weighted and waiting time of rows with ``start`` and ``execution``, per key.

    Rows overlap with later ones that start before they end. A range join on equal keys; within a
    key the number of overlaps follows the parallelism of the run.
    """
    order = Window.partitionBy(key).orderBy("start", "index")
    rows = starts.withColumn("end", F.col("start") + F.col("execution")).withColumn("rk", F.row_number().over(order))
    a, b = rows.alias("a"), rows.select(key, F.col("start").alias("bs"), F.col("end").alias("be"), F.col("execution").alias("bx"), F.col("rk").alias("brk")).alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("brk") > F.col("rk")) & (F.col("bs") <= F.col("end")), "left")
    frame = Window.partitionBy(F.col(f"a.{key}"), "index").orderBy("brk").rowsBetween(Window.unboundedPreceding, -1)
    finished = F.greatest(F.col("start"), F.coalesce(F.max("be").over(frame), F.col("start")))
    some = F.col("bs").isNotNull()
    gap = F.when(some, F.greatest(F.lit(0.0), F.least("bs", "end") - finished)).otherwise(0.0)
    shared = F.when(some, F.least(F.col("end") - F.col("bs"), F.col("bx"))).otherwise(0.0)
    each = pairs.select(F.col(f"a.{key}").alias(key), "index", "start", "end", "execution", gap.alias("gap"), shared.alias("shared"), "be")
    total = each.groupBy(key, "index", "start", "end", "execution").agg(F.sum("gap").alias("gap"), F.sum("shared").alias("shared"), F.max("be").alias("last"))
    wtime = F.col("gap") + F.greatest(F.lit(0.0), F.col("end") - F.greatest(F.col("start"), F.coalesce("last", F.col("start"))))
    etime = F.when(F.col("execution") == 0, 0.0).otherwise(F.col("execution") * F.col("execution") / F.nullif(F.col("execution") + F.col("shared"), F.lit(0.0)))
    return total.select(key, "index", F.coalesce(etime, F.lit(0.0)).alias("etime"), wtime.alias("wtime"))


def results_only(profile: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``profile`` whose index ``kept`` has, and of their ordered groups of dependencies only such
    indices, in place; groups that become empty close up. Dependencies are taken apart once, and put
    together in one shuffle by their row."""
    rows = profile.join(kept.select("index"), "index", "left_semi")
    groups = rows.select(F.col("index").alias("src"), F.posexplode("depends").alias("group_no", "g"))
    each = groups.select("src", "group_no", F.posexplode("g").alias("pos", "dst")).join(kept.select(F.col("index").alias("dst")), "dst", "left_semi")
    one = each.repartition("src").groupBy("src", "group_no").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("g"))
    all_ = one.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("group_no", "g"))).alias("gs"))
    lists = all_.select(F.col("src").alias("index"), F.transform("gs", lambda x: F.transform(x["g"], lambda y: y["dst"])).alias("depends"))
    return rows.drop("depends").join(lists, "index", "left").withColumn("depends", F.coalesce("depends", F.array().cast("array<array<bigint>>"))).select(*profile.columns)
