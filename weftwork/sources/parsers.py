"""Readers of build-tool text formats; each gives a DataFrame."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def makefile_rules(text: str) -> list[tuple[str, list[str]]]:
    """(target, dependencies) of each target, in order: comments end a line, a final backslash
    carries it on, an escaped blank belongs to the name."""
    joined = re.sub(r"\\\n", " ", text.replace("\r\n", "\n"))
    out = []
    for line in joined.split("\n"):
        targets, colon, rest = line.split("#", 1)[0].partition(":")
        words = lambda s: [w.replace("\\ ", " ") for w in re.findall(r"(?:\\ |[^ \t])+", s)]
        out += [(t, words(rest)) for t in words(targets)]
    return out


_STATEMENT = "file string, seq int, kind string, name string, outputs array<string>, rule string, deps_normal array<string>, deps_implicit array<string>, deps_order_only array<string>, binds map<string,string>"


def expand(text: str, env: dict[str, str]) -> str:
    """Replaces $x, ${x} and the escapes $$, $:, $ and a blank; unknown names are empty."""
    pattern = r"\$(?:\{([A-Za-z0-9_.-]+)\}|([A-Za-z0-9_-]+)|([$: ]))"
    return re.sub(pattern, lambda m: m[3] if m[3] else env.get(m[1] or m[2], ""), text)


def _words(text: str) -> list[str]:
    return re.findall(r"(?:\$[ :$]|[^ \t:|]|\|(?=[^|\s]))+|\|\||\||:", text)


def ninja_statements(text: str, file: str = "") -> list[dict]:
    """One row a statement: build, rule, default, pool, include, subninja, define."""
    lines = re.sub(r"\$\r?\n[ \t]*", "", text).replace("\r\n", "\n").split("\n")
    out: list[dict] = []
    blank = {"outputs": [], "rule": None, "deps_normal": [], "deps_implicit": [], "deps_order_only": []}
    for line in lines:
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        define = re.match(r"([A-Za-z0-9_.-]+)\s*=\s*(.*)$", body)
        if line[0] in " \t" and define:
            if out and out[-1]["kind"] in ("build", "rule", "pool"):
                out[-1]["binds"][define[1]] = define[2]
            continue
        word, _, rest = body.partition(" ")
        row = {"file": file, "seq": len(out), "kind": word, "name": rest.strip(), "binds": {}} | {k: list(v) if v is not None else None for k, v in blank.items()}
        if word == "build":
            words = _words(rest)
            colon = words.index(":")
            groups: list[list[str]] = [[], [], []]
            at = 0
            for w in words[colon + 2 :]:
                if w in ("|", "||"):
                    at = 1 if w == "|" else 2
                else:
                    groups[at].append(w)
            row |= {"name": None, "outputs": [w for w in words[:colon] if w != "|"], "rule": words[colon + 1], "deps_normal": groups[0], "deps_implicit": groups[1], "deps_order_only": groups[2]}
        elif word == "default":
            row |= {"name": None, "outputs": _words(rest)}
        elif word not in ("rule", "pool", "include", "subninja"):
            if not define:
                raise ValueError(f"{file}: cannot read {body[:60]!r}")
            row |= {"kind": "define", "name": define[1], "binds": {define[1]: define[2]}}
        out.append(row)
    return out


def read_config(text: str, seed: dict[str, str] | None = None) -> dict[str, str]:
    """Variables of a configuration in the same syntax; later ones may use earlier ones."""
    env = dict(seed or {})
    for row in ninja_statements(text):
        if row["kind"] == "define":
            env[row["name"]] = expand(row["binds"][row["name"]], env)
    return env


def split_args(text: str) -> list[str]:
    """A command line's words: double quotes keep blanks, a backslash before a quote keeps it."""
    out, now, quoted, some, i = [], "", False, False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] == '"':
            now, some, i = now + '"', True, i + 1
        elif c == '"':
            quoted, some = not quoted, True
        elif c in " \t\n\r" and not quoted:
            if some:
                out.append(now)
            now, some = "", False
        else:
            now, some = now + c, True
        i += 1
    return [*out, now] if some else out


#: Rows that a reader gives at a time, however many a file has.
ROWS = 1 << 14


def makefile_edges(files: DataFrame) -> DataFrame:
    """(file, target, pos, dep) from (file, text): one row a dependency. Rows go out ROWS at a time: files in a
    batch have hundreds of times as many."""
    names = ["file", "target", "pos", "dep"]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str, int, str]]:
        for name, text in zip(batch.column(0), batch.column(1)):
            own = name.as_py()
            for t, deps in makefile_rules(text.as_py() or ""):
                for i, d in enumerate(deps):
                    yield own, t, i, d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows(batch)
            while some := list(itertools.islice(found, ROWS)):
                columns = zip(zip(*some), (pa.string(), pa.string(), pa.int32(), pa.string()))
                yield pa.record_batch([pa.array(c, t) for c, t in columns], names)

    return files.select("file", "text").mapInArrow(run, "file string, target string, pos int, dep string")


def ninja_table(files: DataFrame) -> DataFrame:
    """The statements of (file, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATEMENT.split(", ")]
        for f in frames:
            yield pd.DataFrame([r for name, text in zip(f.file, f.text) for r in ninja_statements(text or "", name)], columns=names)

    return files.select("file", "text").mapInPandas(run, _STATEMENT)


def access_trace(lines: DataFrame) -> DataFrame:
    """(kind, path, other) from trace lines ``k|path[|path]``; unknown lines are left out."""
    pattern = r"^([wrdmqt])\|([^|]*)(?:\|(.*))?$"
    kinds = {"w": "Write", "r": "Read", "d": "Delete", "m": "Move", "q": "Query", "t": "Touch"}
    kind = F.regexp_extract("value", pattern, 1)
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return lines.where(F.col("value").rlike(pattern)).select(name[kind].alias("kind"), F.regexp_extract("value", pattern, 2).alias("path"), F.regexp_extract("value", pattern, 3).alias("other"))


def show_includes(lines: DataFrame, prefix: str = "Note: including file:") -> DataFrame:
    """(path) of a compiler's include notes, those of the system left out."""
    path = F.ltrim(F.substr("value", F.lit(len(prefix) + 1)))
    kept = lines.where(F.col("value").startswith(prefix)).select(path.alias("path"))
    return kept.where(~F.upper("path").rlike(r"PROGRAM FILES|MICROSOFT VISUAL STUDIO"))


PROFILE = "index bigint, name string, execution double, built int, changed int, depends array<array<bigint>>, traces array<struct<command:string,start:double,stop:double>>"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A run profile: one positional row a line, indexed by its place. Rows have four to six
    fields; missing dependencies and traces are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for content in f.content:
                text = bytes(content).decode()
                for i, r in enumerate(json.loads(text[text.index("[") :].rstrip().rstrip(";"))):
                    traces = [{"command": c, "start": float(a), "stop": float(b)} for c, a, b in (r[5] if len(r) > 5 else [])]
                    out.append((i, r[0], float(r[1]), r[2], r[3], r[4] if len(r) > 4 else [], traces))
            yield pd.DataFrame(out, columns=["index", "name", "execution", "built", "changed", "depends", "traces"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PROFILE)


def profile_edges(profile: DataFrame) -> DataFrame:
    """(src, group_no, pos, dst) of a nested profile."""
    groups = profile.select(F.col("index").alias("src"), F.posexplode("depends").alias("group_no", "g"))
    return groups.select("src", "group_no", F.posexplode("g").alias("pos", "dst"))


PROGRESS = ["isFailure", "countSkipped", "countBuilt", "countUnknown", "countTodo", "timeSkipped", "timeBuilt", "timeUnknown"]


def read_progress(lines: DataFrame) -> DataFrame:
    """Progress records from shown (seconds, record) lines, a column ``value`` each; other columns stay."""
    number = r"(-?[0-9.]+(?:e-?[0-9]+)?)"
    field = lambda name: F.regexp_extract("value", rf"{name} = {number}", 1).cast("double").alias(name)
    todo = rf"timeTodo = \({number},(-?[0-9]+)\)"
    return lines.where(F.col("value").rlike(r"^\(")).select(
        *[c for c in lines.columns if c != "value"], F.regexp_extract("value", rf"^\({number},", 1).cast("double").alias("t"), *[field(n) for n in PROGRESS[1:]],
        F.regexp_extract("value", todo, 1).cast("double").alias("todoKnown"), F.regexp_extract("value", todo, 2).cast("double").alias("todoUnknown"))


def listing(spark: SparkSession, directory: str, patterns: list[str]) -> DataFrame:
    """(path, modified, bytes) of the files below a directory that match a pattern, by their
    path from it; contents are not read."""
    from ..functions.patterns import matches_any

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "modificationTime", "length")
    root = re.sub(r"^file:/*", "/", directory).rstrip("/") + "/"
    own = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root), "")
    return files.select(own.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).where(matches_any(patterns, F.col("path")))
