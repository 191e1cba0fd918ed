"""Dense global numbers and running sums without a window over all rows.

Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of the
partitions before it. Only one row a partition is put in order in one task, and partitions are as many as
the session's shuffle partitions, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place below them.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "position", sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with its dense number from 0 in ``order``, and for each of ``sums`` the sum of that column
    over all rows before. Equal rows of ``order`` are numbered in any order: name enough columns.

    The sorted rows are written once to the checkpoint folder, so numbers stay as they are when an executor
    is lost. No rows give no rows; a null counts nothing in a sum.
    """
    sums = sums or {}
    at = F.monotonically_increasing_id()
    rows = df.withColumns({f"_{n}": c.cast("bigint") for n, c in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = _cut(rows.withColumn("_at", at)).withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    each = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    over = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = each.select("_part", over("_n").alias("_first"), *[over(f"_t_{n}").alias(f"_b_{n}") for n in sums])
    out = rows.join(F.broadcast(offsets), "_part")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}
    number = F.col("_first") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return out.withColumns({name: number} | own).select(*df.columns, name, *sums)
