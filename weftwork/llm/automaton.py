"""Repeated word passages, found by streaming word sequences through suffix automata.

Reference shards are the pieces around anchors whose surroundings differ (see ``repeats``); each
shard has a suffix automaton over word hashes whose states keep the first place they end at. As
pieces go in by document and position, that place is the earliest. Streaming a piece gives, word
by word, the longest match that ends there; once it has WINDOW words, the state that holds exactly
these words says whether they start earlier.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Plan, repeated
from .runlength import removed_runs

WINDOW, ANCHOR = 20, 8
#: Words of pieces that one automaton takes; one anchor's pieces stay together.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All runs of the sequences that were added; ``first`` has, by state, the first place at
    which its runs end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, symbols: list[int], place: int) -> None:
        """Adds a sequence whose symbols have the places ``place``, ``place + 1``, ..."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for at, c in enumerate(symbols, place):
            known = nxt[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                cur = len(nxt)
                nxt.append({}), link.append(0), length.append(length[last] + 1), first.append(at)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            else:
                last = self._clone(last, c, known)

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        copy = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), first.append(first[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def stream(self, symbols: list[int], most: int):
        """Yields by symbol (length, state): the longest match of up to ``most`` symbols that ends
        there, and the state that holds it."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            if size >= most:
                size = most
                while length[link[state]] >= most:
                    state = link[state]
            yield size, state


def _mark(flat: np.ndarray, size: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(piece, offset) of the windows that occur at an earlier place of these pieces."""
    symbols = np.unique(flat, return_inverse=True)[1].tolist()
    ends = np.cumsum(size).tolist()
    shard = SuffixAutomaton()
    for s, e in zip([0, *ends], ends):
        shard.add(symbols[s:e], s)
    pieces, offsets, first = [], [], shard.first
    for i, (s, e) in enumerate(zip([0, *ends], ends)):
        for at, (length, state) in enumerate(shard.stream(symbols[s:e], window), s):
            if length == window and first[state] < at:
                pieces.append(i), offsets.append(at - s - window + 1)
    return pieces, offsets


def match(flat: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matcher of ``repeats``: one automaton for the pieces of some anchors at a time."""
    before = np.cumsum(size) - size
    cuts = np.flatnonzero(np.append(True, np.diff(group) != 0))
    pieces, offsets, i = [], [], 0
    while i < len(cuts):
        s, j = int(cuts[i]), i + 1
        while j < len(cuts) and before[cuts[j]] - before[s] < SHARD_WORDS:
            j += 1
        e = int(cuts[j]) if j < len(cuts) else len(size)
        piece, offset = _mark(flat[int(before[s]) : int(before[e - 1] + size[e - 1])], size[s:e], plan.window)
        pieces.append(np.array(piece, np.int64) + s), offsets.append(np.array(offset, np.int64))
        i = j
    piece = np.concatenate(pieces)
    return piece, np.concatenate(offsets), np.ones(len(piece), np.int64)


REPORT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<bigint>"


def _cut(raw, at, rows, mask, i: int) -> bytes:
    """The words of a text that are not marked, joined by one space."""
    words = raw[at[i] : at[i + 1]].tobytes().split()
    own = mask[rows[i] : rows[i + 1]]
    if own.any():
        words = [w for w, gone in zip(words, own.tolist()) if not gone]
    return b" ".join(words)


def _report(doc, raw, at, rows, mask) -> dict:
    n_removed = np.diff(np.append(0, np.cumsum(mask))[rows])
    spans = [removed_runs(mask[s:e]) if n else np.zeros(0, np.int64) for s, e, n in zip(rows[:-1].tolist(), rows[1:].tolist(), n_removed.tolist())]
    digests = [hashlib.sha256(_cut(raw, at, rows, mask, i)).hexdigest() for i in range(len(doc))]
    return {"doc_id": doc, "n_words": np.diff(rows), "n_removed": n_removed, "kept_sha256": digests, "spans": spans}


def _search(docs: DataFrame, window: int, anchor: int, report, schema: str, keep: bool) -> DataFrame:
    return repeated(docs, words=True, window=window, anchor=anchor, within=True, matcher=match, report=report, schema=schema, keep=keep)


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the words that stay joined by one space, and
    the removed runs of words as [start, end, ...].

    A word goes if a window of ``window`` consecutive words that covers it also starts earlier: in
    a document with a lesser doc_id, or before in the same one; windows are judged on the input.
    Words are maximal runs of bytes other than ASCII white space, unchanged; they are told apart by
    XXH64. A null or wordless text has no words. Rows that share a doc_id count as parts of one
    document, ordered by text; a repeat of a whole row as a later part. Rows with a null doc_id are
    left out; extra columns are ignored, whatever their names; no rows give no rows.
    """
    return _search(docs, window, anchor, _report, REPORT, False)


def remove_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, its words then joined by one space
    where something was cut; other columns stay, whatever their names. Documents of which no word
    stays go, wordless ones and rows with a null doc_id stay."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others) or "none: int"

    def cut(doc, raw, at, rows, mask) -> dict:
        n = np.diff(np.append(0, np.cumsum(mask))[rows])
        return {"doc_id": doc, "now": [_cut(raw, at, rows, mask, i).decode() if k else None for i, k in enumerate(n.tolist())], "left": np.diff(rows) - n, "rest": None}

    found = _search(docs, window, anchor, cut, f"doc_id bigint, was string, now string, left bigint, rest struct<{kept}>", True)
    text = lambda f: F.coalesce("now", "was") if f.name == "text" else F.col("doc_id") if f.name == "doc_id" else F.col("rest").getField(f.name)
    found = found.where("now is null or left > 0").select(*(text(f).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    return found.unionByName(docs.where("doc_id is null"))
