"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised to integers in two's complement. The index of a block of rows has, for each
component and each bit, a bitmap over the rows. A query's scores are sums of such slices, shifted by
the bits of its own components; slices are added with bitmap arithmetic (carry-save adders, 64 rows
a word, all queries of a block at once), which gives the scores as bitmaps again. The best rows are
selected from the most significant score slice downward; the rows at the boundary are resolved
exactly, by score and then by the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

#: Rows of an index block, queries added at a time; bytes of components (8 each) of the queries and of
#: the rows that one task has.
ROW_BLOCK, AT_ONCE, QUERY_BYTES, ROW_BYTES = 8192, 128, 32 << 20, 128 << 20


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of one width, their components as integers), width by width: floor(scale * x), x as
    double. Raises ValueError if a component does not fit into 53 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        scaled = np.floor(scale * values[at[own][:, None] + np.arange(width)])
        if np.abs(scaled).max(initial=0) >= 2.0**53:
            raise ValueError("a scaled component does not fit into 53 bits")
        yield own, scaled.astype(np.int64)


def bits_of(values: np.ndarray) -> int:
    """Bits of two's complement that hold all values."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def slices(values: np.ndarray) -> np.ndarray:
    """Bitmaps (component, bit, word) over rows, 64 to a word; the last bit is the sign's."""
    n, width = values.shape
    bits = bits_of(values)
    words = -(-n // 64)
    planes = np.zeros((width, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        planes[:, b, : packed.shape[1]] = packed
    return planes.view(np.uint64)


class Adder:
    """Sums bitmaps of different weights with carry-save adders: at most two wait a weight."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, weight: int, bitmap: np.ndarray) -> None:
        while True:
            held = self.waiting.setdefault(weight, [])
            held.append(bitmap)
            if len(held) < 3:
                return
            a, b, c = held
            half = a ^ b
            self.waiting[weight] = [half ^ c]
            bitmap, weight = (a & b) | (half & c), weight + 1

    def total(self, shape: tuple[int, ...], bits: int) -> list[np.ndarray]:
        """The sum as ``bits`` slices, least significant first, modulo 2**bits."""
        out, carry = [], np.zeros(shape, np.uint64)
        for weight in range(bits):
            held = [*self.waiting.get(weight, ()), carry]
            while len(held) < 3:
                held.append(np.zeros(shape, np.uint64))
            a, b, c = held
            half = a ^ b
            out.append(half ^ c)
            carry = (a & b) | (half & c)
        return out


def scores(index: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Slices (query, word) of the scores in two's complement, least significant first. A bit's
    weight is negative if just one of the two bits is a sign bit; such slices are summed apart and
    subtracted."""
    width, bits, words = index.shape
    query_bits = bits_of(queries)
    shape = (len(queries), words)
    total_bits = bits + query_bits + int(width).bit_length()
    if total_bits > 63:
        raise ValueError("scores do not fit into 63 bits")
    plus, minus = Adder(), Adder()
    for a in range(query_bits):
        chosen = np.where((queries >> a) & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        for d in range(width):
            if not chosen[:, d].any():
                continue
            mask = chosen[:, d, None]
            for b in range(bits):
                to = minus if (a == query_bits - 1) != (b == bits - 1) else plus
                to.add(a + b, mask & index[d, b])
    up, down = plus.total(shape, total_bits), minus.total(shape, total_bits)
    out, borrow = [], np.zeros(shape, np.uint64)
    for x, y in zip(up, down):
        out.append(x ^ y ^ borrow)
        borrow = (~x & (y | borrow)) | (y & borrow)
    return out


def select(score: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps of rows that hold each query's k best and all that tie with the last of them."""
    sure, edge = np.zeros_like(score[0]), live.copy()
    order = [~score[-1], *reversed(score[:-1])]  # the sign: rows without it come first
    for s in order:
        upper = edge & s
        enough = (np.bitwise_count(sure | upper).sum(1, dtype=np.int64) >= k)[:, None]
        sure = np.where(enough, sure, sure | upper)
        edge = np.where(enough, upper, edge & ~s)
    return sure | edge


def best(values: np.ndarray, ids: np.ndarray, index: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query id, row id, score) of the k best rows of this block for each query."""
    n, words = len(ids), index.shape[2]
    all_rows = np.zeros(words * 8, np.uint8)
    packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
    all_rows[: len(packed)] = packed
    order = np.argsort(ids, kind="stable")
    for s in range(0, len(queries), AT_ONCE):
        some, some_ids = queries[s : s + AT_ONCE], query_ids[s : s + AT_ONCE]
        score = scores(index, some)
        live = np.tile(all_rows.view(np.uint64), (len(some), 1))
        # A query is no candidate of its own: rows with its id are taken out.
        low, high = np.searchsorted(ids[order], some_ids, "left"), np.searchsorted(ids[order], some_ids, "right")
        for q in np.flatnonzero(low < high).tolist():
            for r in order[low[q] : high[q]].tolist():
                live[q, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        found = np.unpackbits(select(score, live, k).view(np.uint8), axis=1, bitorder="little")
        q, r = np.nonzero(found)
        value = np.zeros(len(q), np.int64)
        for b, plane in enumerate(score):
            bit = ((plane[q, r // 64] >> (r % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            value += -(bit << b) if b == len(score) - 1 else bit << b
        rank = np.lexsort((ids[r], -value, q))
        q, r, value = q[rank], r[rank], value[rank]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < k
        yield some_ids[q[keep]], ids[r[keep]], value[keep]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return plain.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` highest integer inner products
    with all other rows of ``vectors``, ties to the lesser vec_id; all, if there are fewer.

    Both tables have (vec_id, embedding). Rows whose vector is null, empty, or holds a null or
    non-finite component take no part, nor do rows with a null id. A query meets the rows of its own
    width. Repeated ids are rows of their own; rows with the query's id are not its candidates; of
    repeated query ids the least vector is asked. Extra columns are ignored; no rows give no rows.
    Components beyond 53 bits and scores beyond 63 raise ValueError.

    Queries and rows are dealt by hash into parts of bounded bytes, and each pair of parts is one
    group: it builds the index of its rows and asks its queries. Only group sizes come from counts;
    no vector passes through the driver and nothing is broadcast.
    """
    spark = vectors.sparkSession
    rows, asked = _usable(vectors), _usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    volume = lambda df: df.agg(F.coalesce(F.sum(F.size("embedding").cast("bigint")), F.lit(0))).first()[0] * 8
    asked_parts = parts(volume(_usable(queries)), QUERY_BYTES)
    row_parts = parts(volume(rows), ROW_BYTES, -(-spark.sparkContext.defaultParallelism // asked_parts))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "embedding", deal(row_parts).alias("r"), every(asked_parts).alias("q"))
    right = asked.select("vec_id", "embedding", every(row_parts).alias("r"), deal(asked_parts).alias("q"))

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        by_width = {q.shape[1]: (at, q) for at, q in quantised(wanted.column("embedding"), scale)} if wanted.num_rows else {}
        query_ids, ids = (t.column("vec_id").to_numpy().astype(np.int64) for t in (wanted, own))
        for at, values in quantised(own.column("embedding"), scale) if by_width and own.num_rows else ():
            asked_at, query_values = by_width.get(values.shape[1], (None, None))
            for s in range(0, len(at) if asked_at is not None else 0, ROW_BLOCK):
                block = values[s : s + ROW_BLOCK]
                out += best(block, ids[at[s : s + ROW_BLOCK]], slices(block), query_values, query_ids[asked_at], k)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
