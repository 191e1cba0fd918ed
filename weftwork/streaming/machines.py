"""State machines over records, put together from small ones and run in batch or as a stream.

A machine is a start state and a step from (state, record) to (state, output). The combinators below give
machines of machines; whatever is built runs over the ordered records of each key, either as a fold of a
whole table or record by record in a stream, where the state is kept between micro-batches.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from .progress import divide


@dataclass(frozen=True)
class Machine:
    start: Any
    step: Callable[[Any, Any], tuple[Any, Any]]


def echo() -> Machine:
    """Gives each record as it is."""
    return Machine(None, lambda s, x: (s, x))


def always(value: Any) -> Machine:
    return Machine(None, lambda s, x: (s, value))


def lift(f: Callable, *parts: Machine) -> Machine:
    """``f`` of what all parts give for a record; each part keeps its own state."""

    def step(states: tuple, x: Any) -> tuple:
        both = [m.step(s, x) for m, s in zip(parts, states)]
        return tuple(s for s, _ in both), f(*[out for _, out in both])

    return Machine(tuple(m.start for m in parts), step)


def scan(f: Callable[[Any, Any], Any], first: Any, of: Machine) -> Machine:
    """The running result of ``f``(result so far, output)."""

    def step(state: tuple, x: Any) -> tuple:
        inner, out = of.step(state[0], x)
        now = f(state[1], out)
        return (inner, now), now

    return Machine((of.start, first), step)


def old(first: Any, of: Machine) -> Machine:
    """(output before, output): before the first record there was ``first``."""
    return scan(lambda pair, new: (pair[1], new), (first, first), of)


def latch(of: Machine) -> Machine:
    """Of outputs (hold, value) the value, but while ``hold`` the one given last, if there is one."""
    kept = scan(lambda before, now: before if now[0] and before is not None else (now[1],), None, of)
    return lift(lambda x: x[0], kept)


def iff(test: Machine, yes: Machine, no: Machine) -> Machine:
    """What ``yes`` or ``no`` gives; both step on every record."""
    return lift(lambda c, t, f: t if c else f, test, yes, no)


def decay(factor: float, above: Machine, below: Machine) -> Machine:
    """The ratio of two growing outputs, what is new weighing ``factor`` times."""

    def ratio(r: float, pairs: tuple) -> float:
        (a0, a), (b0, b) = pairs
        return divide(a, b) if math.isnan(r) else divide(r * b0 + factor * (a - a0), b0 + factor * (b - b0))

    return scan(ratio, 0.0, lift(lambda a, b: (a, b), old(0.0, above), old(0.0, below)))


def changes(of: Machine) -> Machine:
    """Each output that differs from the one before; None for the others, which leave no row."""
    return lift(lambda pair: None if pair[0] == pair[1] else pair[1][0], old(None, lift(lambda x: (x,), of)))


def remaining() -> Machine:
    """(seconds left, percent done) of progress records with the fields of ``progress.FIELDS``."""
    field = lambda name: lift(lambda r: r[name], echo())
    done, built = field("timeBuilt"), field("countBuilt")
    known = lift(lambda r: r["countTodo"] - r["todoUnknown"], echo())
    still = lift(lambda pair: pair[0] == pair[1], old(0.0, done))
    rate = latch(lift(lambda hold, value: (hold, value), still, decay(1.2, done, field("t"))))
    speed = iff(lift(lambda x: x == 0, done), always(1.0), rate)

    def average(w1: float, x1: float, w2: float, x2: float) -> float:
        part = lambda w, x: 0.0 if w == 0 else w * x
        return 0.0 if w1 == 0 and w2 == 0 else divide(part(w1, x1) + part(w2, x2), w1 + w2)

    rule = lift(average, built, decay(10, done, built), known, lift(divide, field("todoKnown"), known))
    todo = lift(lambda r, each: r["todoKnown"] + r["todoUnknown"] * each, echo(), rule)
    percent = lift(lambda d, t: 0.0 if d == 0 else divide(100 * d, d + t), done, todo)
    return lift(lambda left, share: (left, share), lift(divide, todo, speed), percent)


def _stepped(machine: Machine, state: Any, rows: pd.DataFrame, names: list[str], key: Any, order: str) -> tuple[Any, list[tuple]]:
    out = []
    for values in rows[names].itertuples(index=False, name=None):
        record = dict(zip(names, values))
        state, found = machine.step(state, record)
        if found is not None:
            out.append((key, record[order], *(found if isinstance(found, tuple) else (found,))))
    return state, out


def fold(records: DataFrame, key: str, order: str, machine: Machine, outputs: str) -> DataFrame:
    """(key, order, outputs): what a machine gives for the records of each key in their order; nothing where it
    gives None. A key's records are one group; equal places in the order come in any order. No rows give no rows."""
    names = [c for c in records.columns if c != key]
    schema = f"{records.select(key, order).schema.simpleString()[7:-1]},{outputs}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, out = _stepped(machine, machine.start, rows.sort_values(order, kind="stable"), names, rows[key].iloc[0], order)
        return pd.DataFrame(out, columns=[key, order, *columns])

    columns = [c.split()[0] for c in outputs.split(", ")]
    return records.groupBy(key).applyInPandas(run, schema)


def stream(records: DataFrame, key: str, order: str, machine: Machine, outputs: str) -> DataFrame:
    """As ``fold`` over a stream: within a micro-batch records are put in order, and the state of each key is
    kept until the next one."""
    names = [c for c in records.columns if c != key]
    schema = f"{records.select(key, order).schema.simpleString()[7:-1]},{outputs}"
    columns = [c.split()[0] for c in outputs.split(", ")]

    def run(name: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else machine.start
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        state, out = _stepped(machine, state, rows, names, name[0], order)
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=[key, order, *columns])

    return records.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")
