"""Long repeated byte strings, found with run-length compressed Burrows-Wheeler transforms.

A collection of texts is indexed by the runs of its BWT, with the suffix array sampled at both
ends of every run. Matching statistics stream over that index from right to left: while the BWT's
character at the current row is the next one, the match grows by a step of LF; else the walk moves
to the nearest run of that character above or below, whichever sampled end shares more with the
match so far. Where the match has WINDOW bytes, the row's interval tells the least document that
holds these bytes. For a corpus the collections are the pieces around anchors whose surroundings
differ (see ``repeats``), so an index never has to hold more than a range of anchor hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Plan, repeated

WINDOW, ANCHOR = 50, 20
#: Bytes of pieces that one index takes; one anchor's pieces stay together.
INDEX_BYTES = 1 << 19


class RunLengthIndex:
    """Index of texts given as one byte array and their lengths; each text ends with a mark of its
    own, less than any byte, so no match runs into the next text. What stays after the build: the
    bytes, for comparisons at a change of runs; per run of the BWT its first row, letter and the
    suffixes sampled at both ends; and, if ``doc`` is given, the intervals of equal ``window``-byte
    strings with the least document that holds each."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, doc: np.ndarray | None = None, window: int = WINDOW):
        n, texts = len(flat) + len(size), len(size)
        self.begin = np.cumsum(size + 1) - size - 1
        self.text = np.full(n, 0, np.int64)
        body = np.ones(n, bool)
        marks = self.begin + size
        body[marks] = False
        self.text[body] = flat.astype(np.int64) + 1
        suffixes = self._sorted(n, texts, marks)
        before = self.text[suffixes - 1]  # of the first text's start: the last mark
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.heads, self.letters = heads, before[heads]
        lengths = np.diff(np.append(heads, n))
        self.first_sample = suffixes[heads]
        self.last_sample = suffixes[heads + lengths - 1]
        # Runs ordered by letter, then place: the key of run r of letter c is c * runs + r.
        order = np.argsort(self.letters, kind="stable")
        self.keys = self.letters[order] * len(heads) + order
        self.order = order
        upto = np.cumsum(lengths[order]) - lengths[order]
        self.lf_of_head = np.empty(len(heads), np.int64)  # LF maps a run's head to its letter's rows in order
        self.lf_of_head[order] = upto
        if doc is not None:
            self.first, self.least = self._intervals(suffixes, marks, doc, window)

    def _sorted(self, n: int, texts: int, marks: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling, from ranks of 7 bytes on."""
        packed = np.zeros(n, np.uint64)
        stop = np.zeros(n, np.int64)  # bytes to the text's mark
        where = np.arange(n)
        nearest = marks[np.minimum(np.searchsorted(marks, where), texts - 1)]
        stop = nearest - where
        for i in range(7):
            at = np.minimum(where + i, n - 1)
            packed = (packed << np.uint64(9)) | np.where(i < stop, self.text[at], 0).astype(np.uint64)
        which = np.where(stop < 7, np.searchsorted(marks, where), 0)  # ends so near are told apart by their text
        order = np.lexsort((which, packed))
        rank = self._ranks(order, packed, which)
        width = 7
        while rank[order[-1]] < n - 1:
            key = rank * (n + 1) + np.where(stop >= width, rank[np.minimum(where + width, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank = self._ranks(order, key)
            width *= 2
        return order

    @staticmethod
    def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes, up to ``most``, that the suffixes at a and b share."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        limit = len(self.text) - 1
        for i in range(most):
            x, y = self.text[np.minimum(a[live] + i, limit)], self.text[np.minimum(b[live] + i, limit)]
            live = live[(x == y) & (x > 0)]
            if not len(live):
                break
            out[live] = i + 1
        return out

    def _step(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        return self.lf_of_head[run] + row - self.heads[run]

    def statistics(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int):
        """Yields, from the last byte of each pattern back, (patterns, offset in each, bytes
        matched, row): the longest match, up to ``most`` bytes, of what starts there."""
        row, run = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        place, length = self.first_sample[row].copy(), np.zeros(len(size), np.int64)  # row 0 heads a run
        runs = len(self.heads)
        for back in range(1, int(size.max(initial=0)) + 1):
            who = np.flatnonzero(size >= back)
            letter = flat[begin[who] + size[who] - back].astype(np.int64) + 1
            run = np.searchsorted(self.heads, row[who], "right") - 1
            same = self.letters[run] == letter
            now, at, grown = row[who], place[who] - 1, length[who] + 1
            off = np.flatnonzero(~same)
            if len(off):
                w, c, r = who[off], letter[off], run[off]
                k = np.searchsorted(self.keys, c * runs + r)
                below = np.minimum(k, len(self.keys) - 1)
                has_below = self.keys[below] // runs == c
                above = np.maximum(k - 1, 0)
                has_above = (k > 0) & (self.keys[above] // runs == c)
                down, up = self.order[below], self.order[above]
                low, high = self.first_sample[down], self.last_sample[up]
                d = np.where(has_below, self.shared(place[w], low, most), -1)
                u = np.where(has_above, self.shared(place[w], high, most), -1)
                lower = d >= u
                best = np.maximum(d, u)
                new_run = np.where(lower, down, up)
                ends = np.append(self.heads[1:], len(self.text)) - 1
                now[off] = np.where(lower, self.heads[new_run], ends[new_run])
                run[off] = new_run
                at[off] = np.where(lower, low, high) - 1
                grown[off] = np.minimum(length[w], best) + 1
                lost = off[best < 0]  # the letter is nowhere: start again
                grown[lost] = 0
            ok = grown > 0
            row[who] = np.where(ok, self._step(now, run), row[who])
            place[who] = np.where(ok, at, place[who])
            length[who] = np.minimum(grown, most)
            yield who, size[who] - back, length[who], row[who]

    def _intervals(self, suffixes: np.ndarray, marks: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(first rows of the intervals of suffixes that start with equal ``window``-byte strings, the
        least document of each); the interval of a shorter suffix is its own row. Bytes are compared."""
        n = len(self.text)
        owner = np.minimum(np.searchsorted(marks, suffixes), len(marks) - 1)
        whole = marks[owner] - suffixes >= window
        same = whole[1:] & whole[:-1]
        at = np.flatnonzero(same)
        raw = np.zeros(n + 8, np.uint8)
        raw[:n] = np.maximum(self.text - 1, 0)
        eight = np.zeros(n, np.uint64)
        for i in range(8):
            eight |= raw[i : n + i].astype(np.uint64) << np.uint64(8 * i)
        width = min(8, window)
        if width < 8:
            eight &= np.uint64((1 << 8 * width) - 1)
        for i in sorted({*range(0, window - width + 1, width), window - width}):
            at = at[eight[suffixes[at] + i] == eight[suffixes[at + 1] + i]]
        new = np.ones(n, bool)
        new[at + 1] = False
        first = np.flatnonzero(new)
        return first, np.minimum.reduceat(doc[owner], first)


def _mark(flat: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows that a piece of a lesser document holds too."""
    index = RunLengthIndex(flat, size, doc, window)
    begin = np.cumsum(size) - size
    pieces, offsets = [], []
    for who, offset, length, row in index.statistics(flat, begin, size, window):
        hit = np.flatnonzero(length >= window)
        hit = hit[index.least[np.searchsorted(index.first, row[hit], "right") - 1] < doc[who[hit]]]
        pieces.append(who[hit]), offsets.append(offset[hit])
    return np.concatenate(pieces), np.concatenate(offsets)


def match(flat: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matcher of ``repeats``: indexes the pieces of some anchors at a time."""
    bytes_before = np.cumsum(size) - size
    cuts = np.flatnonzero(np.append(True, np.diff(group) != 0))
    out, i = [], 0
    while i < len(cuts):
        s = int(cuts[i])
        j = i + 1
        while j < len(cuts) and bytes_before[cuts[j]] - bytes_before[s] < INDEX_BYTES:
            j += 1
        e = int(cuts[j]) if j < len(cuts) else len(size)
        stop = int(bytes_before[e - 1] + size[e - 1])
        piece, offset = _mark(flat[int(bytes_before[s]) : stop], size[s:e], doc[s:e], plan.window)
        out.append((piece + s, offset))
        i = j
    piece, offset = (np.concatenate(x) for x in zip(*out))
    return piece, offset, np.ones(len(piece), np.int64)


REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


def removed_runs(own: np.ndarray) -> np.ndarray:
    """The maximal runs of a mask as [start, end, start, end, ...]."""
    step = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).reshape(-1)


def _report(doc, raw, at, rows, mask) -> dict:
    size, n_removed = np.diff(at), np.diff(np.append(0, np.cumsum(mask))[at])
    runs, digests = [np.zeros(0, np.int64)] * len(doc), []
    for i, (s, e, n) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), n_removed.tolist())):
        if n:
            runs[i] = removed_runs(mask[s:e])
        digests.append(hashlib.sha256((raw[s:e][~mask[s:e]] if n else raw[s:e]).tobytes()).hexdigest())
    return {"doc_id": doc, "n_bytes": size, "n_removed": n_removed, "n_spans": [len(r) // 2 for r in runs], "kept_sha256": digests, "spans": runs}


def _search(docs: DataFrame, window: int, anchor: int, report, schema: str, keep: bool) -> DataFrame:
    return repeated(docs, words=False, window=window, anchor=anchor, within=False, matcher=match, report=report, schema=schema, keep=keep)


def long_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what stays, and the
    runs themselves as [start, end, start, end, ...].

    A byte goes if a ``window``-byte string that covers it also starts in a document with a lesser
    doc_id; strings are judged on the input. A null text is empty; texts shorter than ``window``
    stay whole. Rows that share a doc_id are judged one by one and never against each other; rows
    with a null doc_id are left out. Extra columns are ignored, whatever their names; no rows give
    no rows.
    """
    return _search(docs, window, anchor, _report, REPORT, False)


def remove_long_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, and ``n_chars`` of what stays if there
    is such a column; other columns and rows stay, texts that become empty and rows with a null
    doc_id too. A character of which a byte was cut loses its other bytes. Columns may have any name."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others) or "none: int"

    def cut(doc, raw, at, rows, mask) -> dict:
        texts = [None] * len(doc)
        for i, (s, e, any_) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), (np.diff(np.append(0, np.cumsum(mask))[at]) > 0).tolist())):
            if any_:
                texts[i] = raw[s:e][~mask[s:e]].tobytes().decode("utf-8", "ignore")
        return {"doc_id": doc, "now": texts, "rest": None}

    schema = f"doc_id bigint, was string, now string, rest struct<{kept}>"
    found = _search(docs, window, anchor, cut, schema, True)
    changed = F.col("now").isNotNull()
    columns = []
    for f in docs.schema.fields:
        if f.name == "doc_id":
            column = F.col("doc_id").cast(f.dataType)
        elif f.name == "text":
            column = F.coalesce("now", "was").cast(f.dataType)
        else:
            column = F.col("rest").getField(f.name)
            if f.name == "n_chars":
                column = F.when(changed, F.length("now").cast(f.dataType)).otherwise(column)
        columns.append(column.alias(f.name))
    return found.select(*columns).unionByName(docs.where("doc_id is null"))
