"""Remaining time from a stream of progress counters.

The machine keeps a decayed work rate and a decayed time a rule; it steps once a record. It runs in
batch, a whole trace a group, and as a stateful stream, where records of a micro-batch are ordered
by time before they step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame

FIELDS = ["t", "timeBuilt", "countBuilt", "countTodo", "todoKnown", "todoUnknown"]


def divide(a: float, b: float) -> float:
    """Division with infinities and NaN instead of an error."""
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)


def decay(ratio: float, factor: float, a0: float, a: float, b0: float, b: float) -> float:
    """The ratio a / b when both grow, what is new weighing ``factor`` times."""
    return divide(a, b) if math.isnan(ratio) else divide(ratio * b0 + factor * (a - a0), b0 + factor * (b - b0))


@dataclass
class State:
    done: float = 0.0
    seconds: float = 0.0
    rate: float = 0.0
    shown_rate: float = math.nan  # NaN: nothing was shown yet
    built_time: float = 0.0
    built_count: float = 0.0
    rule_ratio: float = 0.0


def step(s: State, t: float, time_built: float, count_built: float, count_todo: float, todo_known: float, todo_unknown: float) -> tuple[State, float, float]:
    """(next state, seconds left, percent done)."""
    rate = decay(s.rate, 1.2, s.done, time_built, s.seconds, t)
    still = time_built == s.done
    shown = s.shown_rate if still and not math.isnan(s.shown_rate) else rate
    ratio = decay(s.rule_ratio, 10, s.built_time, time_built, s.built_count, count_built)
    known = count_todo - todo_unknown
    part = lambda w, x: 0.0 if w == 0 else w * x
    weight = count_built + known
    rule = 0.0 if count_built == 0 and known == 0 else divide(part(count_built, ratio) + part(known, divide(todo_known, known)), weight)
    todo = todo_known + todo_unknown * rule
    left = divide(todo, 1.0 if time_built == 0 else shown)
    percent = 0.0 if time_built == 0 else divide(100 * time_built, time_built + todo)
    return State(time_built, t, rate, shown, time_built, count_built, ratio), left, percent


def replay(progress: DataFrame, key: str) -> DataFrame:
    """Per trace ``key`` and record: seconds left and percent as they were and as predicted."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable")
        state, out, end = State(), [], float(frame["t"].iloc[-1])
        for row in zip(*(frame[c].astype(float) for c in FIELDS)):
            state, left, percent = step(state, *row)
            out.append((str(frame[key].iloc[0]), row[0], end - row[0], divide(row[0] * 100, end), left, percent))
        return pd.DataFrame(out, columns=["key", "t", "idealSecs", "idealPerc", "actualSecs", "actualPerc"])

    return progress.select(key, *FIELDS).groupBy(key).applyInPandas(run, "key string, t double, idealSecs double, idealPerc double, actualSecs double, actualPerc double")


def predict(progress: DataFrame, key: str) -> DataFrame:
    """The stream (key, t, actualSecs, actualPerc) from a stream of progress records; the state of
    a key is seven numbers."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = State(*held.get) if held.exists else State()
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = []
        for row in zip(*(rows[c].astype(float) for c in FIELDS)):
            state, left, percent = step(state, *row)
            out.append((str(name[0]), row[0], left, percent))
        held.update(astuple(state))
        yield pd.DataFrame(out, columns=["key", "t", "actualSecs", "actualPerc"])

    names = "done double, seconds double, rate double, shown double, built_time double, built_count double, ratio double"
    return progress.select(key, *FIELDS).groupBy(key).applyInPandasWithState(run, "key string, t double, actualSecs double, actualPerc double", names, "append", "NoTimeout")


def show(seconds: float, percent: float) -> str:
    """A status such as ``1m05s (40%)``."""
    if math.isnan(seconds) or seconds < 0:
        left = "??s"
    else:
        m, s = divmod(math.ceil(seconds), 60)
        left = f"{m}m{s:02d}s" if m else f"{s}s"
    return f"{left} ({'??' if math.isnan(percent) or not 0 <= percent <= 100 else math.floor(percent)}%)"
