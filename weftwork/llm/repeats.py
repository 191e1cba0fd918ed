"""Exact search for windows of W symbols that occur before, in corpora that fit no one machine.

Symbols are bytes or words. Every window holds a sampled anchor: the run of K symbols with the
least hash in it. Consecutive windows that share an anchor form a unit; a unit's text is its
context. Equal windows have equal anchors, so it is enough to compare units of one anchor:

1. ``_scan`` cuts texts into units, one plain row each. Of units with equal contexts in a batch only
   the first goes on; those of later documents are marked at once.
2. ``_settle`` puts the rows of an anchor together with window functions: units whose context an
   earlier document has are marked whole. Where contexts of an anchor differ, the first of each
   context is asked for its symbols.
3. ``_pieces`` reads these symbols from the texts.
4. ``_match`` streams the pieces, sorted by anchor, through a matcher (a run-length BWT index, or
   suffix automata), which marks the windows that occur earlier.
5. ``_finish`` puts the marks of each document together.

All rows between the steps are plain columns that Spark shuffles, sorts and spills. A passage that
very many documents share sends one row per batch, not one per document. An anchor that a sample
finds to be frequent is dealt by (anchor, context), so its rows spread over tasks; its pieces, as
those of every anchor with more than HOT different contexts, are split STEP windows at a time and
dealt by the symbols these windows share. The sample only chooses how rows are dealt: results are
the same without it. Nothing is capped or gathered on the driver. Anchors and contexts are told
apart by hashes of 64 bits each (runs of at most 2 W symbols); pieces by their symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BYTE_VALUE, Sequence, binary, buffers, is_word_table, materialize, mix, parts, release, runs_of, small, text_bytes, tune, word_bounds, word_hashes

POS_BITS = 21
SLICE_SYMBOLS = 1 << 18
#: Text bytes that one partition of units stands for, and the most partitions.
PART_BYTES, MOST_PARTS = 64 << 20, 32768
#: An anchor with more different contexts than HOT has its pieces split: STEP windows at a time, keyed
#: by the symbols that these windows have in common.
HOT, STEP = 256, 4
#: Text bytes of the sample that frequent anchors are looked for in, the least share of the corpus that it is
#: (one document in so many), and how often frequent ones are in it. By the share, an anchor of some million
#: rows is in the sample of a corpus of any size, and those found are at most one in FREQUENT of its units.
SAMPLE_BYTES, SAMPLE_EVERY, FREQUENT = 32 << 20, 250_000, 16
#: Bytes of pieces that a matcher is given at a time; one anchor's pieces stay together.
MATCH_BYTES = 4 << 20
#: Rows with the same doc_id are told apart by this bit onwards of a position.
ROW_BIT = 40
UNIT, MARK, FREQUENT_UNIT = 0, 1, 2
UNITS = "g bigint, ctx bigint, kind int, doc bigint, start bigint, n int, more array<bigint>"
PIECES = "key bigint, kind int, doc bigint, start bigint, n int, more array<bigint>, symbols binary"
MARKS = "doc bigint, start bigint, n int"


@dataclass(frozen=True)
class Plan:
    """What to search: ``words`` or bytes, ``window`` symbols, anchors of ``anchor`` symbols;
    ``within``: an earlier start in the same document counts too."""

    words: bool
    window: int
    anchor: int
    within: bool


# -- units -----------------------------------------------------------------------------------

def symbols_of(raw: np.ndarray, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(symbols: bytes, or hashes of words; offset of each row in symbols)."""
    if not words:
        return raw, at
    start, end, rows = word_bounds(is_word_table("space")[raw], at)
    return word_hashes(raw, start, end), rows


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, keys
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    return m


def units(symbols: np.ndarray, rows: np.ndarray, window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, context, row, start in the row, windows) of every unit, slice by slice. A long row
    is cut into slices that overlap, so each window is in exactly one of them."""
    i, last = 0, len(rows) - 1
    mask = np.uint64((1 << POS_BITS) - 1)
    while i < last:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + SLICE_SYMBOLS, "right")) - 1)
        s, row_end = int(rows[i]), int(rows[j])
        while True:
            e = min(row_end, s + SLICE_SYMBOLS + window - 1) if j == i + 1 else row_end
            n = e - s
            if n >= window:
                seq = Sequence(BYTE_VALUE[symbols[s:e]] if symbols.dtype == np.uint8 else symbols[s:e])
                grams = seq.fixed(anchor)
                keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
                least = (sliding_min(keys, window - anchor + 1) & mask).astype(np.int64)
                ok = np.ones(n - window + 1, bool)
                ends = rows[i + 1 : j] - s if j > i + 1 else []
                for x in ends:
                    ok[max(0, x - window + 1) : x] = False
                at = np.flatnonzero(ok)
                if len(at):
                    where = least[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
                    first = np.flatnonzero(new)
                    final = np.append(first[1:], len(at)) - 1
                    begin, stop = at[first], at[final] + window
                    row = np.searchsorted(rows, begin + s, "right") - 1
                    yield grams[where[first]], seq.runs(begin, stop), row, begin + s - rows[row], (final - first + 1).astype(np.int32)
            if e >= row_end:
                break
            s = e - window + 1
        i = j


def _leads(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead, late, twin): the first of the entries with the same keys, by document and start, for
    each entry; entries that lie after it (``within``) or in a later document; other entries of the
    lead's own document (none if ``within``)."""
    order = np.lexsort((start, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other = lead != np.arange(len(order))
    late = other if within else doc > doc[lead]
    return lead, late, other & ~late


def _more(lead: np.ndarray, twin: np.ndarray, keep: np.ndarray, start: np.ndarray) -> pa.Array:
    """For each kept entry the starts of its twins; null where there are none."""
    own = np.flatnonzero(twin)
    own = own[np.argsort(lead[own], kind="stable")]
    count = np.bincount(lead[own], minlength=len(lead))[keep]
    at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(start[own], pa.int64()), mask=pa.array(count == 0))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for s in range(0, batch.num_rows, rows):
        yield batch.slice(s, rows)


def _runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks with those that follow one another joined."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.add.reduceat(n, first) if len(first) else n


def _scan(plan: Plan, frequent: np.ndarray) -> Callable:
    """Batches of (doc_id, sub, text) to rows of UNITS. The rows of a frequent anchor have g mixed
    with their context; those of a mark have the document's hash there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sub = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << ROW_BIT
            symbols, rows = symbols_of(*buffers(batch.column(2)), plan.words)
            found = [np.concatenate(x) for x in zip(*units(symbols, rows, plan.window, plan.anchor))]
            if not found:
                continue
            h, ctx, row, start, n = found
            doc, start = ids[row], start + sub[row]
            lead, late, twin = _leads((ctx, h), doc, start, plan.within)
            keep, gone = np.flatnonzero(~late & ~twin), np.flatnonzero(late)
            at = np.minimum(np.searchsorted(frequent, h[keep]), max(0, len(frequent) - 1))
            often = frequent[at] == h[keep] if len(frequent) else np.zeros(len(keep), bool)
            g = np.where(often, mix(h[keep] ^ ctx[keep]), h[keep])
            kind = np.where(often, FREQUENT_UNIT, UNIT).astype(np.int32)
            yield from _cut(pa.record_batch([_signed(g), _signed(ctx[keep]), pa.array(kind), pa.array(doc[keep]), pa.array(start[keep]), pa.array(n[keep]), _more(lead, twin, keep, start)], names=NAMES))
            d, s, m = _runs(doc[gone], start[gone], n[gone])
            nothing = pa.nulls(len(d), pa.list_(pa.int64()))
            yield from _cut(pa.record_batch([_signed(mix(d.view(np.uint64))), pa.array(s), pa.array(np.full(len(d), MARK, np.int32)), pa.array(d), pa.array(s), pa.array(m.astype(np.int32)), nothing], names=NAMES))
            del h, ctx, row, start, n, found, lead, late, twin
            release()

    return run


NAMES = [c.split()[0] for c in UNITS.split(", ")]


def _frequent(rows: DataFrame, plan: Plan, total: int) -> np.ndarray:
    """Sorted hashes of the anchors that a sample of about SAMPLE_BYTES, or one document in SAMPLE_EVERY,
    has FREQUENT times or more: a hint of how to deal rows."""
    every = max(1, min(total // SAMPLE_BYTES, SAMPLE_EVERY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            symbols, at = symbols_of(*buffers(batch.column(2)), plan.words)
            for h, ctx, *_ in units(symbols, at, plan.window, plan.anchor):
                pair = np.unique(np.stack([h, ctx], 1), axis=0)[:, 0]
                anchors, n = np.unique(pair, return_counts=True)
                yield pa.record_batch([_signed(anchors), pa.array(n)], ["h", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    often = sample.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))


def _settle(units_: DataFrame, plan: Plan, partitions: int) -> DataFrame:
    """The marks, and the units whose symbols are asked for: UNITS without ctx; ``kind`` 2 if the
    piece is to be split. A mark of a unit covers its twins too."""
    dealt = units_.repartition(partitions, "g")
    same = Window.partitionBy("g", "kind", "ctx").orderBy("doc", "start")
    anchor = Window.partitionBy("g", "kind")
    rank, first = F.row_number().over(same), F.first("doc").over(same)
    ranked = dealt.withColumn("rank", rank).withColumn("first", first)
    counted = ranked.select("*", F.count(F.when(F.col("rank") == 1, 1)).over(anchor).alias("contexts"), F.min("doc").over(anchor).alias("low"), F.max("doc").over(anchor).alias("high"))
    gone = (F.col("kind") == MARK) | ((F.col("rank") > 1) if plan.within else (F.col("doc") > F.col("first")))
    several = (F.col("contexts") > 1) & (F.lit(True) if plan.within else F.col("low") < F.col("high"))
    kind = F.when(gone, MARK).when(F.col("kind") == FREQUENT_UNIT, FREQUENT_UNIT).when(several & (F.col("contexts") > HOT), FREQUENT_UNIT).when(several, UNIT)
    return counted.select("g", kind.alias("kind"), "doc", "start", "n", "more").where("kind is not null")


# -- pieces ----------------------------------------------------------------------------------

def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all their values); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, column.flatten()


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _split(plan: Plan, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Splits pieces that lie one after another: (piece, first window, windows, key, content). A
    window's place around its anchor follows from its symbols, so equal windows have it alike. STEP
    neighbouring places share all but STEP - 1 of a window's symbols; these, and the place, are the
    key. How many different contents a key has is then up to the language, not to the number of
    documents."""
    size = n + plan.window - 1
    offset = np.cumsum(size) - size
    values = Sequence(symbols if plan.words else BYTE_VALUE[symbols])
    mask = np.uint64((1 << POS_BITS) - 1)
    grams = values.fixed(plan.anchor) & ~mask
    anchor = np.zeros(len(n), np.int64)  # the first of the least in each piece's first window
    least = grams[offset]
    for i in range(1, plan.window - plan.anchor + 1):
        better = grams[offset + i] < least
        anchor[better], least[better] = i, grams[offset + i][better]
    piece = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    place = (anchor[piece] - window) // STEP
    first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(piece)))
    piece, window, place = piece[first], window[first], place[first]
    begin = offset[piece] + anchor[piece] - place * STEP  # where the last of the places has its window start
    core = values.runs(begin, begin - STEP + 1 + plan.window)
    start = offset[piece] + window
    return piece, window, count, mix(core + place.astype(np.uint64)), values.runs(start, start + count + plan.window - 1)


def _pieces(plan: Plan) -> Callable:
    """Batches of (doc_id, sub, text, asked units) to rows of PIECES; kind 1 are marks."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def rows_of(key, kind, doc, start, n, more, symbols, flat):
        size = n.astype(np.int64) + plan.window - 1
        body = symbols[runs_of(flat, size)]
        kinds = pa.array(np.full(len(n), kind, np.int32))
        return pa.record_batch([_signed(key), kinds, pa.array(doc), pa.array(start), pa.array(n.astype(np.int32)), more, binary(body, size * body.dtype.itemsize)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            symbols, rows = symbols_of(*buffers(batch.column(2)), plan.words)
            ids, (size, asked) = _long(batch.column(0)), _lists(batch.column(3))
            g, kind, start, n = (_long(asked.field(i)) for i in range(4))
            doc, row = np.repeat(ids, size), np.repeat(np.arange(len(size)), size)
            flat = rows[row] + (start & ((1 << ROW_BIT) - 1))
            own = np.flatnonzero(kind == UNIT)
            if len(own):
                yield from _cut(rows_of(g[own], UNIT, doc[own], start[own], n[own], asked.field(4).take(pa.array(own)), symbols, flat[own]))
            own = np.flatnonzero(kind == FREQUENT_UNIT)
            if len(own):
                # Twins have the same symbols, so one of them stands for all until pieces are split.
                count, twins = _lists(asked.field(4).take(pa.array(own)))
                piece, window, n_, key, content = _split(plan, symbols[runs_of(flat[own], n[own] + plan.window - 1)], n[own])
                every = np.concatenate([np.arange(len(piece)), np.repeat(np.arange(len(piece)), count[piece])])
                at = np.concatenate([[0], np.cumsum(count)])[piece]
                first = np.concatenate([start[own][piece] + window, _long(twins)[runs_of(at, count[piece])] + np.repeat(window, count[piece])])
                d = doc[own][piece][every]
                # Of equal contents the first here goes on; later documents' are settled.
                lead, late, twin = _leads((content[every], key[every]), d, first, plan.within)
                keep = np.flatnonzero(~late & ~twin)
                place = flat[own][piece[every[keep]]] + window[every[keep]]
                yield from _cut(rows_of(key[every[keep]], UNIT, d[keep], first[keep], n_[every[keep]], _more(lead, twin, keep, first), symbols, place))
                d, s, m = _runs(d[late], first[late], n_[every[late]])
                nothing = pa.nulls(len(d), pa.list_(pa.int64())), pa.nulls(len(d), pa.binary())
                kinds = pa.array(np.full(len(d), MARK, np.int32))
                yield from _cut(pa.record_batch([_signed(mix(d.view(np.uint64))), kinds, pa.array(d), pa.array(s), pa.array(m.astype(np.int32)), *nothing], names=names))
            release()

    return run


def _match(plan: Plan, matcher: Callable) -> Callable:
    """Batches of (key, done, doc, start, n, more, symbols), sorted by key, to rows of MARKS. What is done
    goes on at once; only pieces with symbols are held until their key ends, and of equal ones there is one."""

    def marks(t: pa.Table) -> pa.RecordBatch | None:
        done, doc, start, n = (_long(t.column(i)) for i in (1, 2, 3, 4))
        count, more = _lists(t.column(5))
        first_more = np.cumsum(count) - count
        piece, shift, length = [np.flatnonzero(done)], [np.zeros(int(done.sum()), np.int64)], [n[done > 0]]
        lead = np.flatnonzero(done == 0)
        if len(lead):
            key = _long(t.column(0))[lead]
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            same = np.bincount(group)[group] > 1  # a piece alone has no equal windows
            lead, group = lead[same], group[same]
        if len(lead):
            order = np.lexsort((start[lead], doc[lead], group))
            lead, group = lead[order], group[order]
            raw, at = buffers(t.column(6).take(pa.array(lead)))
            flat = raw.view(np.uint64) if plan.words else raw
            p, s, m = matcher(flat, n[lead] + plan.window - 1, group, doc[lead], plan)
            piece.append(lead[p]), shift.append(s), length.append(m)
        piece, shift, length = (np.concatenate(x) for x in (piece, shift, length))
        twins = count[piece]
        d = np.concatenate([doc[piece], np.repeat(doc[piece], twins)])
        s = np.concatenate([start[piece] + shift, _long(more)[runs_of(first_more[piece], twins)] + np.repeat(shift, twins)])
        d, s, m = _runs(d, s, np.concatenate([length, np.repeat(length, twins)]))
        release()
        return pa.record_batch([pa.array(d), pa.array(s), pa.array(m.astype(np.int32))], names=["doc", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, MATCH_BYTES
        for batch in batches:
            done = batch.column(1)
            if pc.any(pc.equal(done, 1)).as_py():
                yield from _cut(marks(pa.Table.from_batches([batch.filter(pc.equal(done, 1))])))
                batch = batch.filter(pc.equal(done, 0))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                t = pa.Table.from_batches(held).combine_chunks()
                key = _long(t.column(0))
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield from _cut(marks(t.slice(0, cut)))
                held = t.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
                limit = max(MATCH_BYTES, 2 * size)
        if held:
            yield from _cut(marks(pa.Table.from_batches(held).combine_chunks()))

    return run


def spans(flat: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    """A mask of ``total`` symbols: those in any run [flat, flat + length)."""
    edge = np.bincount(flat, minlength=total + 1) - np.bincount(flat + length, minlength=total + 1)
    return np.cumsum(edge[:total]) > 0


def _finish(plan: Plan, report: Callable, schema: str) -> Callable:
    """Batches of (doc_id, sub, text, marks, other columns) to the rows that
    ``report(doc, raw, offsets, symbols up to each text, mask)`` makes, with the other columns."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            raw, at = buffers(batch.column(2))
            rows = word_bounds(is_word_table("space")[raw], at)[2] if plan.words else at
            size, marks = _lists(batch.column(3))
            flat = np.repeat(rows[:-1], size) + (_long(marks.field(0)) & ((1 << ROW_BIT) - 1))
            mask = spans(flat, _long(marks.field(1)) + plan.window - 1, int(rows[-1]))
            made = report(_long(batch.column(0)), raw, at, rows, mask)
            made |= {"was": batch.column(2), "rest": batch.column(4) if batch.num_columns > 4 else None}
            yield pa.record_batch([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in fields], schema=fields)
            release()

    return run


def numbered(docs: DataFrame, keep: bool) -> DataFrame:
    """(doc_id, sub, text, rest): rows that share a doc_id get different numbers, by text. ``rest`` has
    the other columns if they are to be kept. Rows with a null doc_id are left out."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`").alias(c) for c in others)) if keep and others else F.struct(F.lit(None).cast("int").alias("none"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    sub = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1 if twice else F.lit(0)
    return docs.select("doc_id", sub.cast("int").alias("sub"), "text", *(["rest"] if keep else []))


def repeated(docs: DataFrame, *, words: bool, window: int, anchor: int, within: bool, matcher: Callable, report: Callable, schema: str, keep: bool = False) -> DataFrame:
    """Runs the steps above over ``docs`` and returns what ``report`` makes, one row a document."""
    tune(docs.sparkSession)
    plan = Plan(words, window, anchor, within)
    whole = numbered(docs, keep)
    rows = whole.select("doc_id", "sub", "text")
    total = text_bytes(rows)
    partitions = min(MOST_PARTS, parts(total, PART_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    scanned = rows.mapInArrow(_scan(plan, _frequent(rows, plan, total)), UNITS)
    settled = materialize(_settle(scanned, plan, partitions), "settled")
    sub = F.shiftright("start", ROW_BIT).cast("int")
    asked = settled.where(F.col("kind") != MARK).groupBy(F.col("doc").alias("doc_id"), sub.alias("sub"))
    asked = asked.agg(F.collect_list(F.struct("g", "kind", "start", "n", "more")).alias("asked"))
    pieces = rows.join(asked, ["doc_id", "sub"]).select("doc_id", "sub", "text", "asked").mapInArrow(_pieces(plan), PIECES)
    same = Window.partitionBy("key", "kind", "symbols").orderBy("doc", "start")
    late = F.row_number().over(same) > 1 if within else F.col("doc") > F.first("doc").over(same)
    done = ((F.col("kind") == MARK) | late).cast("int")
    dealt = pieces.repartition(partitions, "key").withColumn("done", done).sortWithinPartitions("key")
    kept = F.when(F.col("done") == 0, F.col("symbols"))
    matched = dealt.select("key", "done", "doc", "start", "n", "more", kept.alias("symbols")).mapInArrow(_match(plan, matcher), MARKS)
    known = settled.where(F.col("kind") == MARK).select("doc", F.explode(F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("start"), "n")
    marks = known.unionByName(matched).groupBy(F.col("doc").alias("doc_id"), sub.alias("sub")).agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    last = whole.join(marks, ["doc_id", "sub"], "left").select("doc_id", "sub", "text", "marks", *(["rest"] if keep else []))
    return last.mapInArrow(_finish(plan, report, schema), schema)
