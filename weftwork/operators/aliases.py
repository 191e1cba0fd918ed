"""Names that stand for lists of other names, put in place of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import CycleError, _cut, _union


def expanded(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, way, name): the lists ``wanted`` (id, pos, name) with every alias replaced by what it stands for, and
    that again, until none is left. ``way`` orders the rows of an id: the place in its list, then that in each
    alias on the way. ``aliases``: (name, pos, dep); an alias of nothing has one row with a null dep.

    A name may come several times, as often as lists have it. Raises CycleError for an alias that stands for
    itself. Rounds are as many as aliases are nested; each is written once, and takes only what is an alias still.
    """
    front = _cut(wanted.select("id", F.array(F.col("pos").cast("int")).alias("way"), "name", F.array().cast(f"array<{dict(wanted.dtypes)['name']}>").alias("through")))
    known = _cut(aliases.select(F.col("name").alias("alias"), F.col("pos").cast("int").alias("at"), "dep"))
    names = known.select(F.col("alias").alias("name")).distinct()
    done = []
    while True:
        done.append(front.join(names, "name", "left_anti").select("id", "way", "name"))
        inside = front.join(known, front["name"] == known["alias"])
        step = inside.select("id", F.concat("way", F.array("at")).alias("way"), F.col("dep").alias("name"), F.concat("through", F.array("name")).alias("through"))
        front = _cut(step.where("name is not null"))
        round_ = front.where(F.array_contains("through", F.col("name"))).limit(10).collect()
        if round_:
            raise CycleError([r["name"] for r in round_])
        if front.isEmpty():
            return _union(done)


#: Rows that one task counts: its map of (id, name) holds no more, however many rows there are.
COUNTED = 250_000


def times(rows: DataFrame) -> DataFrame:
    """(id, name, times): how often each id comes to a name, from what ``expanded`` gives. Rows are dealt by both into
    as many tasks as they need: partitions that are joined by their packed size hold too many."""
    tasks = max(1, -(-rows.count() // COUNTED))
    return rows.select("id", "name").repartition(tasks, "id", "name").groupBy("id", "name").agg(F.count("*").alias("times"))
