"""Glob-driven listing: a frontier of directories with the states of a pattern automaton.

A round takes all directories of one depth: those whose state has wildcards are listed, of the others
only the names that their patterns have are looked up; what cannot match is never visited. A tree of
files is read where its source is: folders by the executors, or a table of entries by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pattern_set import PatternSet
from ..operators.graph import _cut, _union

_FRONT = "dir string, places array<int>"
_FOUND = "dir string, path string, kind string, places array<int>"
#: Gives (dir, places, name, is_dir) of the entries of a frontier (dir, places, listed, names).
Entries = Callable[[DataFrame], DataFrame]


def _file_system(root: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), root.rstrip("/") or "/") if "://" not in root and not root.startswith("file:") else fs.FileSystem.from_uri(root.rstrip("/"))


def folder(root: str) -> Entries:
    """The entries of a folder that all executors reach, of any file system that pyarrow knows. Raises
    FileNotFoundError when the rows are asked for, if the folder itself is missing."""

    def entries(front: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            system, top = _file_system(root)
            if system.get_file_info(top).type != fs.FileType.Directory:
                raise FileNotFoundError(f"{root} does not exist")
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    base = f"{top}/{row['dir']}" if row["dir"] else top
                    if row["listed"]:
                        infos = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
                    else:
                        infos = system.get_file_info([f"{base}/{n}" for n in row["names"]])
                    for info in infos:
                        if info.type in (fs.FileType.File, fs.FileType.Directory):
                            out.append({"dir": row["dir"], "places": row["places"], "name": info.base_name, "is_dir": info.type == fs.FileType.Directory})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("dir", pa.string()), ("places", pa.list_(pa.int32())), ("name", pa.string()), ("is_dir", pa.bool_())]))

        return front.mapInArrow(run, "dir string, places array<int>, name string, is_dir boolean")

    return entries


def entry_table(table: DataFrame) -> Entries:
    """The entries of a table (parent, name, is_dir); the parent of the first ones is ''."""

    def entries(front: DataFrame) -> DataFrame:
        own = table.select(F.col("parent").alias("dir"), "name", "is_dir")
        wanted = F.col("listed") | F.array_contains("names", F.col("name"))
        return front.join(own, "dir").where(wanted).select("dir", "places", "name", "is_dir")

    return entries


def tree_of(paths: DataFrame) -> DataFrame:
    """(parent, name, is_dir): the entries of a tree with the files of (path)."""
    names = F.split("path", "/")
    steps = paths.select("path").distinct().select(F.posexplode(names).alias("i", "name"), names.alias("names"))
    parent = F.array_join(F.slice("names", 1, F.col("i")), "/")
    return steps.select(parent.alias("parent"), "name", (F.col("i") < F.size("names") - 1).alias("is_dir")).distinct()


def walk(spark: SparkSession, patterns: list[str], entries: Entries, depth: int = 1000) -> DataFrame:
    """(path, kind) below a root: 'file' and 'dir' for what matches a pattern, 'listed' for directories that
    were listed and 'probed' for those where only known names were looked up ('' is the root).

    Patterns are relative to the root; those of absolute paths match nothing. Directories are entered once,
    with the state of all patterns, so no path comes twice. Rounds are as many as the deepest directory
    that can match has components (at most ``depth``); each is written once. No patterns visit nothing.
    """
    whole = PatternSet(patterns)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [whole.state(tuple(p)) for p in batch.column("places").to_pylist()]
            names = [sorted(s.literal) for s in states]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([whole.listed(s) for s in states]), pa.array(names, pa.list_(pa.string()))], names=["dir", "places", "listed", "names"])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state = whole.step(whole.state(tuple(row["places"])), row["name"])
                path = f"{row['dir']}/{row['name']}" if row["dir"] else row["name"]
                if state.accepted:
                    out.append({"dir": row["dir"], "path": path, "kind": "dir" if row["is_dir"] else "file", "places": []})
                if row["is_dir"] and whole.on(state):
                    out.append({"dir": row["dir"], "path": path, "kind": "next", "places": list(state.places)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dir", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("places", pa.list_(pa.int32()))]))

    first = whole.start()
    front = spark.createDataFrame([("", list(first.places))] if whole.on(first) else [], _FRONT)
    done = []
    for _ in range(depth):
        seen = _cut(front.mapInArrow(looked, f"{_FRONT}, listed boolean, names array<string>"))
        done.append(seen.select(F.col("dir").alias("path"), F.when(F.col("listed"), "listed").otherwise("probed").alias("kind")))
        found = _cut(entries(seen).mapInArrow(stepped, _FOUND))
        done.append(found.where("kind <> 'next'").select("path", "kind"))
        front = found.where("kind = 'next'").select(F.col("path").alias("dir"), "places")
        if front.isEmpty():
            break
    return _union(done)


def files(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """(path) of the files below a folder that match a pattern, in order."""
    return walk(spark, patterns, folder(root)).where("kind = 'file'").select("path").orderBy("path")


def directories(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the directories in a folder, in order."""
    return walk(spark, ["*"], folder(root)).where("kind = 'dir'").select("path").orderBy("path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all entries of a folder, in order."""
    return walk(spark, ["*"], folder(root)).where("kind in ('file', 'dir')").select("path").orderBy("path")


def exists(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (path) with is_file and is_dir, looked up below a folder by the executors; a null path is
    neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = _file_system(root)
        for batch in batches:
            names = batch.column("path").to_pylist()
            kinds = iter(system.get_file_info([f"{top}/{n}" for n in names if n is not None]))
            found = [next(kinds).type if n is not None else None for n in names]
            columns = [pa.array([k == t for k in found], pa.bool_()) for t in (fs.FileType.File, fs.FileType.Directory)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], names=["path", "is_file", "is_dir"])

    return paths.select("path").mapInArrow(run, "path string, is_file boolean, is_dir boolean")
