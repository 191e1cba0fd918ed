"""Scheduling simulations over one run's profile. They are sequential by nature, so a profile is one
group; different thread counts or profiles run in parallel."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Clock:
    """The state of a simulated run: what runs, by its end (of equal ends what began last is first),
    and when each task began and ended."""

    def __init__(self, execution: list[float]):
        self.execution, self.now, self.running = execution, 0.0, []
        self.began: dict[int, float] = {}
        self.ended: dict[int, float] = {}

    def begin(self, task: int) -> None:
        self.began[task] = self.now
        heapq.heappush(self.running, (self.now + self.execution[task], -len(self.began), task))

    def next_end(self) -> int:
        self.now, _, task = heapq.heappop(self.running)
        self.ended[task] = self.now
        return task

    def check(self) -> None:
        if len(self.ended) < len(self.execution):
            raise ValueError("some tasks wait for each other")


def _groups(depends: Iterable) -> list[list[list[int]]]:
    return [[[int(x) for x in group] for group in own] for own in depends]


def _users(groups: list[list[list[int]]]) -> dict[int, list[int]]:
    """By task, who depends on it: once for each mention."""
    users: dict[int, list[int]] = {}
    for task, own in enumerate(groups):
        for dependency in itertools.chain.from_iterable(own):
            users.setdefault(dependency, []).append(task)
    return users


def simulate(execution: list[float], depends: Iterable, threads: int) -> tuple[float, list[float]]:
    """(makespan, start of each task) of a list scheduler with ``threads`` workers that takes the
    task that became ready last."""
    groups, clock = _groups(depends), _Clock(execution)
    users = _users(groups)
    open_ = {task: n for task, own in enumerate(groups) if (n := sum(map(len, own)))}
    stack = [task for task in range(len(groups)) if task not in open_]
    while stack or clock.running:
        if stack and len(clock.running) < threads:
            clock.begin(stack.pop())
            continue
        for user in users.get(clock.next_end(), ()):
            open_[user] -= 1
            if not open_[user]:
                stack.append(user)
    clock.check()
    return clock.now, [clock.began[task] for task in range(len(groups))]


def precise_path(execution: list[float], depends: Iterable) -> float:
    """The makespan with any number of workers if a task demands its groups one after another.

    Each demanded task is a generator that yields the unfinished tasks of a group and goes on when
    they have ended; after its last group it begins. Tasks that nothing depends on are demanded first."""
    groups, clock = _groups(depends), _Clock(execution)
    users = _users(groups)

    def life(task: int):
        for group in groups[task]:
            if missing := {x for x in group if x not in clock.ended}:
                yield missing
        clock.begin(task)

    lives: dict[int, object] = {}
    missing: dict[int, set[int]] = {}
    watched: dict[int, list[int]] = {}

    def go_on(tasks: list[int]) -> None:
        while tasks:
            task = tasks.pop()
            for dependency in missing.setdefault(task, set()) or next(lives.setdefault(task, life(task)), ()):
                missing[task].add(dependency)
                watched.setdefault(dependency, []).append(task)
                if dependency not in lives:
                    lives[dependency] = life(dependency)
                    tasks.append(dependency)

    go_on([task for task in range(len(groups)) if task not in users])
    while clock.running:
        ended = clock.next_end()
        freed = []
        for task in watched.pop(ended, ()):
            missing[task].discard(ended)
            if not missing[task]:
                freed.append(task)
        go_on(freed)
    clock.check()
    return clock.now


def _rows(frame: pd.DataFrame) -> tuple[list[float], list]:
    frame = frame.sort_values("index")
    return _placed(frame["index"].tolist(), frame["execution"].astype(float).tolist(), frame["depends"])


def _placed(index: list[int], execution: list[float], depends: Iterable) -> tuple[list[float], list]:
    """Seconds and dependencies of tasks in the order of their index, which becomes their place."""
    place = {x: i for i, x in enumerate(index)}
    return execution, [[[place[x] for x in g] for g in d] for d in depends]


def _each(profile: DataFrame, key: str, make: Callable[[str, list[float], list], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``make`` gives for each profile. A profile is one row of arrays, and a batch has many: profiles
    may be small and many, and a group of its own for each costs more than its simulation."""
    task = F.struct("index", F.col("execution").cast("double").alias("execution"), "depends")
    rows = profile.groupBy(F.col(key).cast("string").alias("key")).agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    kinds = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for name, tasks in zip(part.column(0), part.column(1)):
                    own = tasks.as_py()
                    out += make(name.as_py(), *_placed([t["index"] for t in own], [t["execution"] for t in own], [t["depends"] for t in own]))
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return rows.mapInArrow(run, schema)


def parallelism(profile: DataFrame, key: str, most: int = 24) -> DataFrame:
    """Per profile ``key`` and number of threads: makespan, the ideal one, and the gap between."""

    def make(name: str, execution: list[float], depends: list) -> Iterable[tuple]:
        for n in range(1, most + 1):
            real, ideal = simulate(execution, depends, n)[0], sum(execution) / n
            yield name, n, real, ideal, max(0.0, real - ideal)

    return _each(profile, key, make, "key string, threads int, realistic double, ideal double, gap double")


def starts(profile: DataFrame, key: str, threads: int = 24) -> DataFrame:
    """(key, index, start, execution) at a number of threads."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        execution, depends = _rows(frame)
        return pd.DataFrame({"key": frame[key].astype(str), "index": frame["index"], "start": simulate(execution, depends, threads)[1], "execution": execution})

    return profile.select(key, "index", "execution", "depends").groupBy(key).applyInPandas(run, "key string, index bigint, start double, execution double")


def precise_critical_path(profile: DataFrame, key: str) -> DataFrame:
    """Per profile: the critical path that honours the order of dependency groups."""
    return _each(profile, key, lambda name, execution, depends: [(name, precise_path(execution, depends))], "key string, seconds double")


def lanes(traces: DataFrame, key: str) -> DataFrame:
    """Packs each key's traces into lanes: the first one that is free at a trace's start, else a new one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start", "stop", "command"])
        ends: list[float] = []
        out = []
        for s, e in zip(frame["start"], frame["stop"]):
            lane = next((i for i, end in enumerate(ends) if end <= s), len(ends))
            ends[lane:lane + 1] = [e]
            out.append(lane)
        return pd.DataFrame({"key": frame[key].astype(str), "command": frame["command"], "start": frame["start"], "stop": frame["stop"], "lane": out})

    return traces.select(key, "command", "start", "stop").groupBy(key).applyInPandas(run, "key string, command string, start double, stop double, lane int")
