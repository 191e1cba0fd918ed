"""Hard negatives by an exact nearest-neighbour join over Voronoi cells.

Vectors are quantised to integers; a pair's score is their inner product. With M the greatest norm, a row
x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0): then the squared distance is
|a|^2 + M^2 - 2 * score, so the best scores are the nearest rows. Rows are assigned to the nearest of some
pivots, anchors are grouped by neighbouring cells, and a row goes to a group only where the triangle
inequality, by its distance to its pivot and the group's least and greatest distances, leaves a score
that some anchor of the group has use for. Each group then joins exactly, with integer scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts

#: At most so many pivots and bytes of them; bytes of anchors and of rows that one task has (8 a
#: component); groups of anchors at least, if there are as many cells; anchors and rows scored at a time.
PIVOTS, PIVOT_BYTES, ANCHOR_BYTES, ROW_BYTES, GROUPS, ANCHORS, ROWS = 128, 16 << 20, 4 << 20, 32 << 20, 4, 256, 8192
#: Products are exact as doubles below the first bound, as 64-bit integers below the second.
EXACT, LARGEST = 2.0**50, 9e16


def usable(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part; v = floor(scale * x), x as double."""
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return kept.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows of one width, their matrix), width by width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of no chunk
        column = pa.array([], column.type)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        yield own, values[at[own][:, None] + np.arange(width)]


class Cells:
    """Pivots in the space with one more dimension. Shorter vectors count as followed by zeros, which
    changes no product."""

    def __init__(self, pivots: np.ndarray, greatest: float):
        self.greatest, self.pivots = greatest, pivots
        norms = (pivots**2).sum(1)
        self.last = np.sqrt(np.maximum(greatest - norms, 0))
        self.norms = norms + self.last**2
        #: What rounding may do to a distance.
        self.slack = 1e-5 * (1 + np.sqrt(greatest))

    def distances(self, x: np.ndarray, row: bool) -> np.ndarray:
        """From each vector to each pivot; of rows with their last component, of anchors without."""
        norm = (x**2).sum(1)
        last = np.sqrt(np.maximum(self.greatest - norm, 0)) if row else np.zeros(len(x))
        square = (norm + last**2)[:, None] + self.norms - 2 * (x @ self.pivots[:, : x.shape[1]].T + last[:, None] * self.last)
        return np.sqrt(np.maximum(square, 0))

    def chain(self, weight: np.ndarray, groups: int) -> np.ndarray:
        """The group of each cell: cells in a chain from neighbour to neighbour, cut where the weight passes
        a share of the whole."""
        left, order = set(range(len(self.pivots))), [0]
        left.discard(0)
        while left:
            rest = np.array(sorted(left))
            gap = ((self.pivots[rest] - self.pivots[order[-1]]) ** 2).sum(1)
            order.append(int(rest[gap.argmin()]))
            left.discard(order[-1])
        sums = np.cumsum(weight[order]) - weight[order]
        out = np.zeros(len(order), np.int64)
        out[order] = np.minimum(sums * groups // max(1, int(weight.sum())), groups - 1)
        return out


def _pivots(rows: DataFrame, greatest: float, widest: int) -> Cells:
    """Pivots from a bounded sample of rows, those of the least hash of their id, each the farthest from the
    ones before: any pivots give exact results, apart ones give tighter cells."""
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, widest))))
    some = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(4 * most).select("v").collect()] or [[]]
    matrix = np.zeros((len(some), widest))
    for i, v in enumerate(some):
        matrix[i, : len(v)] = v
    chosen, gap = [0], np.full(len(some), np.inf)
    while len(chosen) < most:
        gap = np.minimum(gap, ((matrix - matrix[chosen[-1]]) ** 2).sum(1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return Cells(matrix[chosen], greatest)


def _first(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row among those that fit, of equal ones those of the
    lesser columns; by row."""
    if np.count_nonzero(fits) * 8 <= fits.size:  # few: sort them
        i, j = np.nonzero(fits)
        order = np.lexsort((j, -score[i, j], i))
        i, j = i[order], j[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        return i[kept], j[kept]
    low = -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min
    held = np.where(fits, score, low)
    n = held.shape[1]
    bar = np.partition(held, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(held), 1), low, held.dtype)
    above = fits & (held > bar)
    edge = fits & (held == bar)
    return np.nonzero(above | (edge & (np.cumsum(edge, axis=1) <= k - above.sum(1)[:, None])))


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both tables as numbers that are equal where the labels are."""
    both = pa.chunked_array([*a.chunks, *b.chunks], pa.string()).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    codes = both.indices.to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a) :]


def _blocks(anchors: pa.Table, rows: pa.Table, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of anchors, places of rows in the order of their ids, scores, whether the ids differ, whether
    the labels are the same) of blocks of anchors and rows of one width."""
    if not anchors.num_rows or not rows.num_rows:
        return
    a_id, r_id = (t.column("id").to_numpy().astype(np.int64) for t in (anchors, rows))
    a_label, r_label = _codes(anchors.column("label"), rows.column("label"))
    by_width = {x.shape[1]: (own, x) for own, x in _matrices(rows.column("v"))}
    for a_own, a_all in _matrices(anchors.column("v")):
        r_own, r_all = by_width.get(a_all.shape[1], (np.zeros(0, np.int64), None))
        order = np.argsort(r_id[r_own], kind="stable")
        for s in range(0, len(r_own), ROWS):
            some = order[s : s + ROWS]
            r, x = r_own[some], r_all[some].astype(dtype)
            for q in range(0, len(a_own), ANCHORS):
                a = a_own[q : q + ANCHORS]
                yield a, r, a_all[q : q + ANCHORS].astype(dtype) @ x.T, a_id[a][:, None] != r_id[r], a_label[a][:, None] == r_label[r]


def _positives(k: int, dtype: type):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        a_id, r_id = (t.column("id").to_numpy().astype(np.int64) for t in (anchors, rows))
        for a, r, score, other, same in _blocks(anchors, rows, dtype):
            i, j = _first(score, other & same, k)
            out.append((a_id[a[i]], r_id[r[j]], score[i, j].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int, dtype: type):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        r_id, a_id = rows.column("id").to_numpy().astype(np.int64), anchors.column("id").to_numpy().astype(np.int64)
        held = anchors.column("scores").to_pylist()
        deep = max(map(len, held), default=0)
        bars = np.zeros((len(held), deep), np.int64)
        for i, h in enumerate(held):
            bars[i, : len(h)] = h
        count = np.array([len(h) for h in held], np.int64)
        for a, r, score, other, same in _blocks(anchors, rows, dtype):
            unlike = other & ~same
            for p in range(deep):
                bar = bars[a, p, None].astype(dtype)
                fits = unlike & (100 * score >= low * bar) & (100 * score <= high * bar) & (count[a] > p)[:, None]
                if fits.any():
                    i, j = _first(score, fits, k)
                    out.append((a_id[a[i]], np.full(len(i), p + 1, np.int64), r_id[r[j]], score[i, j].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "place", "negative_id", "negative_score"])

    return run


class Join:
    """The cells of all rows and the groups of anchors; ``serve`` brings together what may score enough."""

    def __init__(self, rows: DataFrame, asked: Column, scale_bytes: int = 8):
        """``rows``: (id, label, v), written; ``asked``: which rows are anchors."""
        size, norm = F.size("v"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        count = rows.agg(F.sum(size.cast("bigint")).alias("all"), F.max(size).alias("widest"), F.max(norm).alias("norm"), F.sum(F.when(asked, size.cast("bigint"))).alias("asked")).first()
        self.greatest, self.widest = count["norm"] or 0.0, count["widest"] or 0
        if self.greatest >= LARGEST:
            raise ValueError("scores do not fit into 63 bits")
        self.dtype = np.float64 if self.greatest < EXACT else np.int64
        self.cells = cells = _pivots(rows, self.greatest, self.widest)
        self.n = n = len(cells.pivots)
        self.groups = min(n, parts((count["asked"] or 0) * scale_bytes, ANCHOR_BYTES, GROUPS))
        spark = rows.sparkSession
        self.row_parts = parts((count["all"] or 0) * scale_bytes, ROW_BYTES, -(-spark.sparkContext.defaultParallelism // self.groups))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, gap = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for own, x in _matrices(batch.column("v")):
                    for s in range(0, len(own), ROWS):
                        d = cells.distances(x[s : s + ROWS], True)
                        cell[own[s : s + ROWS]], gap[own[s : s + ROWS]] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

        assigned = rows.mapInArrow(assign, "id bigint, label string, v array<double>, cell int, gap double")
        self.rows = materialize(assigned.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.row_parts)).cast("int")), "cells")
        # Of repeated anchor ids the least label and vector is asked.
        once = self.rows.where(asked).groupBy("id").agg(F.min(F.struct("label", "v", "cell", "part")).alias("r")).select("id", "r.label", "r.v", "r.cell", "r.part")
        weight = np.zeros(n, np.int64)
        for r in self.rows.where(asked).groupBy("cell").agg(F.sum(size.cast("bigint")).alias("w")).collect():  # a row a pivot
            weight[r["cell"]] = r["w"]
        group = cells.chain(weight, self.groups)
        # A group's anchors are cut into blocks of bounded size, however many share a cell.
        load = np.bincount(group, weight, self.groups)
        self.blocks = [max(1, int(-(-w * scale_bytes // ANCHOR_BYTES))) for w in load]
        mapped, cut = F.array(*[F.lit(int(g)) for g in group]), F.array(*map(F.lit, self.blocks))
        g = F.get(mapped, F.col("cell"))
        self.anchors = once.withColumn("group", g).withColumn("block", F.pmod(F.xxhash64("id"), F.get(cut, g)).cast("int"))

    def own_bar(self, k: int, asked: Column) -> DataFrame:
        """(id, bar): the k-th best score of each anchor with rows of its label in its own cell and part, so
        a bound from below of its k-th best of all; null if there are fewer."""
        run = _positives(k, self.dtype)

        def local(rows: pa.Table) -> pa.Table:
            found = run(rows.filter(rows.column("asked")), rows).to_pandas()
            best = found.sort_values("positive_score", ascending=False).groupby("anchor_id").head(k).groupby("anchor_id").positive_score.agg(["min", "size"])
            best = best[best["size"] == k]
            return pa.table([pa.array(best.index.to_numpy(np.int64)), pa.array(best["min"].to_numpy(np.int64))], names=["id", "bar"])

        found = self.rows.select("id", "label", "v", "cell", "part", asked.alias("asked")).groupBy("cell", "part").applyInArrow(local, "id bigint, bar bigint")
        return found.groupBy("id").agg(F.max("bar").alias("bar"))

    def serve(self, anchors: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
        """(anchors, rows), both with (g, q, r): each pair of an anchor and a row whose score may be from ``low``
        to ``high`` (null: unbounded) meets in one group of the three. Anchors repeat by parts of rows, rows by
        the groups that they may serve."""
        cells, n, groups = self.cells, self.n, self.groups + 1
        # Anchors without a bound take any row: they are a group of their own, so that the others' bounds count.
        unbound, blocks = low.isNull(), [*self.blocks, sum(self.blocks)]
        anchors = anchors.withColumns({"group": F.when(unbound, self.groups).otherwise(F.col("group")), "block": F.when(unbound, F.pmod(F.xxhash64("id"), F.lit(blocks[-1])).cast("int")).otherwise(F.col("block"))})

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group = batch.column("group").to_numpy()
                low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high"))
                least, most, hole = np.full((groups, n), np.inf), np.full((groups, n), -np.inf), np.full((groups, n), np.inf)
                for own, x in _matrices(batch.column("v")):
                    for s in range(0, len(own), ROWS):
                        at = own[s : s + ROWS]
                        d = cells.distances(x[s : s + ROWS], False)
                        square = (x[s : s + ROWS] ** 2).sum(1) + cells.greatest
                        far = np.where(np.isnan(low[at]), np.inf, np.sqrt(np.maximum(square - 2 * low[at], 0)))[:, None]
                        near = np.where(np.isnan(high[at]), 0, np.sqrt(np.maximum(square - 2 * high[at], 0)))[:, None]
                        np.minimum.at(least, group[at], d - far)
                        np.maximum.at(most, group[at], d + far)
                        np.minimum.at(hole, group[at], near - d)
                some = np.unique(group)
                g, j = np.repeat(some, n), np.tile(np.arange(n), len(some))
                columns = [pa.array(g.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(np.ravel(b[some])) for b in (least, most, hole)]]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "j", "least", "most", "hole"])

        # At most a row for each pivot and group, of which there are no more than pivots and one: a bounded table.
        rings = anchors.select("group", "v", low.cast("double").alias("low"), high.cast("double").alias("high")).mapInArrow(bounds, "g int, j int, least double, most double, hole double")
        rings = rings.groupBy("g", "j").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("hole").alias("hole"))
        gap, slack = F.col("gap"), F.lit(float(cells.slack))
        fits = (self.rows["cell"] == rings.j) & (gap >= rings.least - slack) & (gap <= rings.most + slack) & (gap >= rings.hole - slack)
        cut = F.get(F.array(*map(F.lit, blocks)), F.col("g"))
        rows = self.rows.join(F.broadcast(rings), fits).select("g", F.explode(F.sequence(F.lit(0), cut - 1)).alias("q"), F.col("part").alias("r"), *[F.col(c).alias(c) for c in ("id", "label", "v")])
        spread = anchors.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(self.row_parts - 1)))).withColumnsRenamed({"group": "g", "block": "q"})
        return spread, rows


def mine(vectors: DataFrame, asked: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, positive_place, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` percent of the positive's. First are higher
    scores, then lesser ids; where there are fewer, all.

    ``vectors`` has (vec_id, embedding) and what ``asked`` (which rows are anchors, over ``id``) and
    ``label`` need; extra columns are ignored. A score is the inner product of floor(scale * x). Rows with a
    null id, label or vector, or a null or non-finite component take no part. Only vectors of one width
    meet; empty ones score 0. Repeated rows are rows of their own, but rows with the anchor's id are not its
    partners, and of repeated anchors the least label and vector is asked. Positives with a negative
    score have no negatives, as no score is from 80 to 100 percent of theirs. Squared norms of 9e16 and
    more raise ValueError. No rows give no rows.
    """
    rows = materialize(usable(vectors, F.col("label") if label is None else label, scale), "vectors")
    join = Join(rows, asked)
    bars = join.own_bar(positives, asked)
    anchors = join.anchors.join(bars, "id", "left")
    left, right = join.serve(anchors, F.col("bar"), F.lit(None))
    keys = ("g", "q", "r")
    found = left.select(*keys, "id", "label", "v").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_positives(positives, join.dtype), "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    liked = materialize(found.withColumn("positive_place", F.row_number().over(best)).where(F.col("positive_place") <= positives), "positives")
    bars = liked.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_place", "positive_score"))).alias("p"))
    bars = bars.select(F.col("anchor_id").alias("id"), F.transform("p", lambda x: x["positive_score"]).alias("scores"))
    anchors = join.anchors.join(bars, "id")
    least, most = F.element_at("scores", -1) * (low / 100), F.get("scores", F.lit(0)) * (high / 100)
    left, right = join.serve(anchors, least, most)
    found = left.select(*keys, "id", "label", "v", "scores").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _negatives(negatives, low, high, join.dtype), "anchor_id bigint, place bigint, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = ranked.withColumnRenamed("place", "positive_place").join(liked, ["anchor_id", "positive_place"]).select(
        "anchor_id", "positive_id", "positive_place", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    discard(rows)
    return out
