"""The query language over profiles: predicates that may also name a row's group.

An expression is a pair of columns, whether the row stays and the strings it adds to its group
key. ``&``, ``|`` and ``~`` follow short-circuit evaluation: a side that would not be evaluated
adds nothing. No text is ever compiled or evaluated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_GROUP = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_GROUP)


@dataclass(frozen=True)
class Match:
    keep: Column
    groups: Column

    def __and__(self, other: Match) -> Match:
        return Match(self.keep & other.keep, F.when(self.keep, F.concat(self.groups, other.groups)).otherwise(self.groups))

    def __or__(self, other: Match) -> Match:
        return Match(self.keep | other.keep, F.when(self.keep, self.groups).otherwise(F.concat(self.groups, other.groups)))

    def __invert__(self) -> Match:
        return Match(~self.keep, self.groups)


@dataclass(frozen=True)
class Regex:
    """A regular expression (``named("x")`` is a plain substring)."""

    pattern: str

    def captures(self, text: Column) -> Column:
        n = re.compile(self.pattern).groups
        return F.array(*[F.regexp_extract(text, self.pattern, i + 1) for i in range(n)]).cast(NO_GROUP)


def _test(what: str | Regex, text: Column) -> tuple[Column, Column]:
    if isinstance(what, Regex):
        return text.rlike(what.pattern), what.captures(text)
    return F.contains(text, F.lit(what)), _none()


def _choose(hit: Column, captures: Column, default: str | None) -> Match:
    if default is None:
        return Match(hit, F.when(hit, captures).otherwise(_none()))
    return Match(F.lit(True), F.when(hit, captures).otherwise(F.array(F.lit(default))))


def leaf() -> Match:
    return Match(F.size("depends") == 0, _none())


def run(i: int) -> Match:
    return Match(F.col("built") == i, _none())


def changed() -> Match:
    return Match(F.col("changed") == F.col("built"), _none())


def unchanged() -> Match:
    return Match(F.col("changed") != F.col("built"), _none())


def group(text: Column) -> Match:
    return Match(F.lit(True), F.array(text).cast(NO_GROUP))


def named(what: str | Regex, default: str | None = None) -> Match:
    """Tests the name; a regular expression's captures go to the group; with ``default`` every row
    stays, and one that does not match has that group."""
    return _choose(*_test(what, F.col("name")), default)


def command(what: str | Regex, default: str | None = None) -> Match:
    """As ``named``, of the first traced command that matches."""
    first = F.get(F.filter("traces", lambda t: _test(what, t["command"])[0]), F.lit(0))["command"]
    captures = _test(what, first)[1]
    return _choose(F.exists("traces", lambda t: _test(what, t["command"])[0]), captures, default)


def first_command() -> Column:
    return F.coalesce(F.get("traces", F.lit(0))["command"], F.lit(""))


def search(profile: DataFrame, match: Match) -> DataFrame:
    """The rows that stay, with their ``group``: the captures joined by a space, or the own name."""
    kept = profile.where(match.keep).withColumn("_g", match.groups)
    return kept.withColumn("group", F.when(F.size("_g") == 0, F.col("name")).otherwise(F.array_join("_g", " "))).drop("_g")
