"""Which rule makes a key: many rules against many keys in one pass.

Rules are given as a tree: ``rule`` has patterns, ``priority`` and ``versioned`` hold for all below (the
outermost priority and the innermost version count), and of ``alternatives`` only the first that matches
is a candidate. Of a key's candidates those of the highest priority are left; a key should have one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pattern_set import PatternSet


SCHEMA = T.StructType([T.StructField("matching", T.IntegerType()), T.StructField("candidates", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType())])


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[str, ...]
    priority: float | None = None
    alternative: object = None
    version: int | None = None


def rule(name: str, *patterns: str) -> list[Rule]:
    """One rule for any of some patterns."""
    return [Rule(name, patterns)]


def priority(value: float, *rules: list[Rule]) -> list[Rule]:
    return [replace(r, priority=float(value)) for rs in rules for r in rs]


def versioned(version: int, *rules: list[Rule]) -> list[Rule]:
    return [replace(r, version=version if r.version is None else r.version) for rs in rules for r in rs]


def alternatives(*rules: list[Rule]) -> list[Rule]:
    group = object()
    return [replace(r, alternative=group) for rs in rules for r in rs]


class MultipleRulesError(ValueError):
    """Several rules of the highest priority match a key; ``some`` names at most ten such keys and counts."""

    def __init__(self, some: list[tuple[str, int]]):
        super().__init__(f"key matches multiple rules: {some}")
        self.some = some


class RuleSet:
    """A flat list of rules, in order."""

    def __init__(self, *rules: list[Rule]):
        self.rules = [r for rs in rules for r in rs]
        self.owner = [i for i, r in enumerate(self.rules) for _ in r.patterns]
        groups: dict[int, int] = {}
        #: Numbers of the groups of alternatives; a rule of none is alone.
        self.group = [groups.setdefault(id(r.alternative), i) if r.alternative is not None else i for i, r in enumerate(self.rules)]
        self.patterns = [p for r in self.rules for p in r.patterns]

    def candidates(self, matched: tuple[int, ...]) -> list[int]:
        """The rules left for a key that these patterns match."""
        hits = sorted({self.owner[p] for p in matched})
        first = {}
        for i in hits:
            first.setdefault(self.group[i], i)
        rank = lambda i: 1.0 if self.rules[i].priority is None else self.rules[i].priority
        top = max(map(rank, first.values()), default=0)
        return [i for i in first.values() if rank(i) == top]


def rules_of(keys: DataFrame, rules: RuleSet, key: str = "key") -> DataFrame:
    """``keys`` with ``matching`` (how many rules match), ``candidates`` (how many are left by alternatives
    and priority), ``rule`` and ``version``: the name and version of the one that is left, null if none or
    several are; version is 0 unless given. One pass, no shuffle; a null key has no rule."""
    whole, flat = PatternSet(rules.patterns), rules.rules
    cells = [(r.name, r.version or 0) for r in flat]
    owner, choose = rules.owner, rules.candidates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, ...], tuple] = {}  # by the patterns that match: few, whatever the keys

        def decide(found: tuple[int, ...]) -> tuple:
            if found not in kept:
                if len(kept) > 1 << 16:
                    kept.clear()
                left = choose(found)
                kept[found] = (len({owner[p] for p in found}), len(left), *(cells[left[0]] if len(left) == 1 else (None, None)))
            return kept[found]

        for batch in batches:
            out = [decide(whole.match(k) if k is not None else ()) for k in batch.column(key).to_pylist()]
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "matching", "candidates", "rule", "version"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, *SCHEMA.fields]))


def one_rule(keys: DataFrame, rules: RuleSet, key: str = "key") -> DataFrame:
    """As ``rules_of``, but raises MultipleRulesError if a key has several candidates."""
    found = rules_of(keys, rules, key)
    some = found.where(F.col("candidates") > 1).select(key, "candidates").limit(10).collect()
    if some:
        raise MultipleRulesError([tuple(r) for r in some])
    return found
