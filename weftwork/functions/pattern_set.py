"""Many file patterns as one automaton over the components of a path.

A state is the set of places in all patterns that a path so far may have come to; what follows from it
by a component is worked out once and kept. So a path costs its components, however many patterns there
are, and a directory's state says which of its entries can still match at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .patterns import SKIP, SKIP1, STAR, parse, relative_only

#: Steps and places of states that a worker keeps before it starts anew: bounds memory, changes no result.
KEPT = 1 << 16


class _State:
    """Ways on from a set of places: always (any component), by a literal, or by pieces around stars."""

    def __init__(self, whole: PatternSet, places: tuple[int, ...]):
        self.places, self.steps = places, {}
        self.accepted = tuple(whole.final[s] for s in places if s in whole.final)
        self.always, self.literal, self.pieces = set(), {}, {}
        for s in places:
            part = whole.parts[s]
            if part is SKIP:
                self.always |= whole.closed[s]
            elif part is STAR:
                self.always |= whole.closed[s + 1]
            elif isinstance(part, str):
                self.literal.setdefault(part, set()).update(whole.closed[s + 1])
            elif isinstance(part, tuple):
                # Found by what comes before the first and after the last star; the rest is compared then.
                ends = self.pieces.setdefault((len(part[0]), len(part[-1])), {})
                ends.setdefault((part[0], part[-1]), []).append((part[1:-1], s + 1))

    def targets(self, whole: PatternSet, name: str) -> set[int]:
        out = self.always | self.literal.get(name, set())
        for (a, b), ends in self.pieces.items():
            if len(name) >= a + b:
                for middle, to in ends.get((name[:a], name[len(name) - b :]), ()):
                    at, end = a, len(name) - b
                    for piece in middle:
                        at = name.find(piece, at, end)
                        if at < 0:
                            break
                        at += len(piece)
                    else:
                        out = out | whole.closed[to]
        return out


class PatternSet:
    """The automaton of a list of patterns; a pattern's number is its place in the list."""

    def __init__(self, patterns: list[str]):
        self.patterns = list(patterns)
        self._build()

    def __reduce__(self):
        return PatternSet, (self.patterns,)

    def _build(self) -> None:
        self.parts, self.final, first = [], {}, []
        for p, pattern in enumerate(self.patterns):
            first.append(len(self.parts))
            for part in parse(pattern):
                self.parts += [STAR, SKIP] if part is SKIP1 else [part]
            self.final[len(self.parts)] = p
            self.parts.append(None)
        #: Places that a place stands for too, as the part there may be nothing.
        self.closed: list[set[int]] = [set() for _ in self.parts]
        for s in reversed(range(len(self.parts))):
            self.closed[s] = {s} | (self.closed[s + 1] if self.parts[s] is SKIP or self.parts[s] == "." else set())
        self.first = {absolute: tuple(sorted(set().union(*[self.closed[s] for s, p in zip(first, self.patterns) if not (absolute and relative_only(p))]))) for absolute in (True, False)}
        self._forget()

    def _forget(self) -> None:
        self._states, self._kept = {}, 0

    def state(self, places: tuple[int, ...]) -> _State:
        found = self._states.get(places)
        if found is None:
            if self._kept > KEPT:
                self._forget()
            self._kept += 1 + len(places)
            found = self._states[places] = _State(self, places)
        return found

    def step(self, state: _State, name: str) -> _State:
        found = state.steps.get(name)
        if found is None:
            if self._kept > KEPT:
                self._forget()
            found = self.state(tuple(sorted(state.targets(self, name))))
            # A state that was given up keeps nothing more.
            if self._states.get(state.places) is state:
                self._kept += 1
                state.steps[name] = found
        return found

    def start(self, absolute: bool = False) -> _State:
        return self.state(self.first[absolute])

    def match(self, path: str) -> tuple[int, ...]:
        """The numbers of the patterns that match a path."""
        state = self.start(path.startswith("/"))
        for name in path.split("/"):
            if not state.places:
                break
            state = self.step(state, name)
        return state.accepted

    def listed(self, state: _State) -> bool:
        """Whether a directory in this state has to be listed: otherwise the names to look for are known."""
        return bool(state.always or state.pieces)

    def on(self, state: _State) -> bool:
        """Whether anything below can match."""
        return bool(state.always or state.pieces or state.literal)


def matched(paths: DataFrame, patterns: list[str], path: str = "path", name: str = "matched") -> DataFrame:
    """``paths`` with an array of the numbers of all patterns that match, in one pass without a shuffle; a
    null path matches none."""
    whole = PatternSet(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole.match(p) if p is not None else () for p in batch.column(path).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return paths.mapInArrow(run, T.StructType([*paths.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
