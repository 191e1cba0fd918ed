"""Writers: profile rows, trace events, summaries, compilation databases, and files that are only
written when they change. Each gives a DataFrame of text lines, which ``write_lines`` stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    """Four decimals at most, without zeros at the end."""
    return F.regexp_replace(F.round(x, 4).cast("decimal(24,4)").cast("string"), r"\.?0+$", "")


def _string(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def profile_json(profile: DataFrame) -> DataFrame:
    """(index, value): one positional row a task; dependencies and traces only where there are some."""
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    depends = listed(F.transform("depends", lambda g: listed(F.transform(g, lambda d: d.cast("string")))))
    traces = listed(F.transform("traces", lambda t: listed(F.array(_string(t["command"]), _number(t["start"]), _number(t["stop"])))))
    has_traces, has_deps = F.size("traces") > 0, F.size("depends") > 0
    parts = F.array(_string(F.col("name")), _number(F.col("execution")), F.col("built").cast("string"), F.col("changed").cast("string"))
    parts = F.when(has_traces, F.concat(parts, F.array(depends, traces))).when(has_deps, F.concat(parts, F.array(depends))).otherwise(parts)
    return profile.select("index", listed(parts).alias("value"))


def trace_events(lanes: DataFrame, process: int) -> DataFrame:
    """(value): complete events in microseconds, one a packed trace (command, start, stop, lane)."""
    micro = lambda x: F.round(x * 1e6).cast("bigint")
    event = F.struct(F.lit(process).alias("pid"), F.col("lane").alias("tid"), F.lit("X").alias("ph"), F.lit("target").alias("cat"), F.col("command").alias("name"), micro(F.col("start")).alias("ts"), micro(F.col("stop") - F.col("start")).alias("dur"))
    return lanes.select(F.to_json(event).alias("value"))


def summary_lines(summary: DataFrame, longest_rule: DataFrame, longest_command: DataFrame) -> DataFrame:
    """(value): the sentences of a run's summary; every input is one row."""
    from ..functions.paths import show_time

    s = summary.crossJoin(longest_rule.select(F.col("name").alias("r"), F.col("seconds").alias("rs"))).crossJoin(longest_command.select(F.col("name").alias("c"), F.col("seconds").alias("cs")))  # single rows
    text = lambda x: x.cast("string")
    lines = F.array(
        F.concat(F.lit("This database has tracked "), text(F.col("runs")), F.lit(" runs.")),
        F.concat(F.lit("There are "), text(F.col("rules")), F.lit(" rules ("), text(F.col("rules_last")), F.lit(" rebuilt in the last run).")),
        F.concat(F.lit("Building required "), text(F.col("traced") + 1), F.lit(" traced commands.")),
        F.concat(F.lit("The total (unparallelised) time is "), show_time(F.col("work")), F.lit(" of which "), show_time(F.col("traced_time")), F.lit(" is traced commands.")),
        F.concat(F.lit("The longest rule takes "), show_time(F.col("rs")), F.lit(" ("), F.col("r"), F.lit(") and the longest traced command takes "), show_time(F.col("cs")), F.lit(" ("), F.col("c"), F.lit(").")),
        F.concat(F.lit("Last run gave an average parallelism of "), F.format_string("%.2f", F.col("trace_parallelism")), F.lit(" times over "), show_time(F.col("end")), F.lit(".")),
    )
    return s.select(F.explode(lines).alias("value"))


def progress_json(replayed: DataFrame) -> DataFrame:
    """(key, value): each trace as JSON with one decimal; raises if a prediction is no number."""
    if not replayed.where(F.isnan("actualSecs") | F.isnan("actualPerc")).isEmpty():
        raise ValueError("a prediction is not a number")
    one = lambda c: F.round(c, 1).alias(c)
    rows = F.array_sort(F.collect_list(F.struct("t", F.struct(*map(one, ("idealSecs", "idealPerc", "actualSecs", "actualPerc"))).alias("v"))))
    return replayed.groupBy("key").agg(rows.alias("rows")).select("key", F.to_json(F.struct(F.col("key").alias("name"), F.transform("rows", lambda r: r["v"]).alias("values"))).alias("value"))


def live_list(results: DataFrame) -> DataFrame:
    """(value): the keys of files that are ready."""
    return results.where("status = 'Ready' and type = 'File'").select(F.col("key").alias("value"))


def compilation_database(statements: DataFrame, rules: list[str], directory: str) -> DataFrame:
    """(value): an entry for each build of the rules: directory, command and the first input. ``$in``
    and ``$out`` are replaced; other variables of the build's own bindings too."""
    builds = statements.where((F.col("kind") == "build") & F.col("rule").isin(rules)).select("rule", "outputs", "deps_normal", "binds")
    commands = statements.where("kind = 'rule'").select(F.col("name").alias("rule"), F.try_element_at("binds", F.lit("command")).alias("command"))
    named = builds.join(commands, "rule")
    put = lambda text, name, value: F.regexp_replace(text, F.lit(rf"\$(?:\{{{name}\}}|{name}\b)"), F.regexp_replace(value, r"([\\$])", r"\\$1"))
    command = put(put(F.col("command"), "in", F.array_join("deps_normal", " ")), "out", F.array_join("outputs", " "))
    command = F.aggregate(F.map_entries("binds"), command, lambda t, e: F.replace(F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]), F.concat(F.lit("$"), e["key"]), e["value"]))
    return named.select(F.to_json(F.struct(F.lit(directory).alias("directory"), command.alias("command"), F.get("deps_normal", F.lit(0)).alias("file"))).alias("value"))


def changed_only(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows (path, content) of ``new`` that ``old`` does not hold with the same content."""
    digest = F.sha2(F.col("content"), 256)
    have = old.select("path", digest.alias("_old"))
    return new.join(have, (new.path == have.path) & (F.sha2(new.content, 256) == have._old), "left_anti")


def write_lines(lines: DataFrame, path: str) -> None:
    """Stores a column ``value`` as text files."""
    lines.select("value").write.mode("overwrite").text(path)
