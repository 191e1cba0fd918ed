"""Byte-pair encoding and decoding with an index of pair occurrences.

The distinct words of a partition's texts stand in one array of symbols. An index maps each pair
that has a rank to all its positions. Ranks are taken in ascending order: all occurrences of a rank
are merged at once, left to right within a word, and the pairs that this makes go to their ranks'
lists. A merge only makes pairs of later ranks, since the merged token was learnt before any pair
that holds it, so each rank comes once and every word ends as if merged alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Vocabulary

#: Characters whose words are encoded together, words kept for later texts, and words of a long
#: text taken at a time.
GROUP_CHARS, KEPT_WORDS, LONG_CHARS, WORDS_AT_ONCE = 3_000_000, 200_000, 2_000_000, 200_000


class PairIndex:
    """Encodes many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        left, right, made = vocabulary.merges.T
        self.size = np.int64(len(vocabulary.token_bytes))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made
        self.none = len(made)
        single = {t: i for i, t in enumerate(vocabulary.token_bytes) if len(t) == 1}
        self.byte_id = np.array([single[bytes([b])] for b in range(256)], np.int64)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self.ranks(self.byte_id[a], self.byte_id[b])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word). No word is empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = len(raw)
        starts = np.cumsum(size) - size
        symbol = np.append(self.byte_id[raw], -1)
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        following[starts + size - 1], before[starts] = n, n
        rank = np.full(n + 1, self.none, np.int64)
        alive = np.ones(n + 1, bool)
        inner = np.flatnonzero(following[:n] < n)
        rank[inner] = self.of_bytes[raw[inner].astype(np.int64) * 256 + raw[inner + 1]]

        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r.astype(np.uint16) if self.none < 1 << 16 else r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
                k = int(r[s])
                if k not in lists:
                    lists[k] = []
                    heappush(active, k)
                lists[k].append(at[s:e])

        index(inner)
        while active:
            now = heappop(active)
            found = lists.pop(now)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[alive[at] & (rank[at] == now)]
            if len(at) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
            if not len(at):
                continue
            if len(at) > 1:
                linked = np.append(False, following[at[:-1]] == at[1:])
                if linked.any():  # a run such as "aaa": every other occurrence, from its left
                    head = np.maximum.accumulate(np.where(linked, -1, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = following[at]
            after = following[gone]
            symbol[at] = self.made[now]
            alive[gone] = False
            rank[gone] = self.none
            following[at] = after
            before[after] = at
            before[n] = n
            prior = before[at]
            prior = prior[prior < n]
            touched = np.concatenate([at, prior[following[prior] < n]])
            nxt = following[touched]
            rank[touched] = np.where(nxt < n, self.ranks(symbol[touched], symbol[nxt]), self.none)
            index(touched)
        return symbol[:n][alive[:n]], np.add.reduceat(alive[:n].astype(np.int64), starts)


def char_class(ranges: list[tuple[int, int]], last: int) -> str:
    return "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in ranges if a <= last)


def word_pattern(classes: dict[str, list[tuple[int, int]]], last: int) -> re.Pattern:
    """The pre-tokenizer's pattern, right for texts without code points above ``last``."""
    letter, number, space = (char_class(classes[x], last) for x in ("letter", "number", "space"))
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec:
    """Encodes and decodes texts; keeps the words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.index = vocabulary, PairIndex(vocabulary)
        self.narrow, self.wide = word_pattern(vocabulary.classes, 0xFFFF), word_pattern(vocabulary.classes, 0x10FFFF)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None
        self.known: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.number = list(map(str, range(len(vocabulary.token_bytes))))
        self._reset()

    def _reset(self) -> None:
        self.known = {s: str(i) for s, i in self.vocabulary.specials.items()}
        self.decoded = {s: self.decode([i]) for s, i in self.vocabulary.specials.items()}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, special strings among them, some at a time."""
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if not part:
                continue
            if part in self.vocabulary.specials:
                yield [part]
                continue
            pattern = self.narrow if len(part) < LONG_CHARS and max(part) <= "￿" else self.wide
            if len(part) < LONG_CHARS:
                yield pattern.findall(part)
            else:
                found = (m.group() for m in pattern.finditer(part))
                while some := list(islice(found, WORDS_AT_ONCE)):
                    yield some

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes the words that are not known yet."""
        new = set().union(*lists)
        if len(self.known) + len(new) > KEPT_WORDS:
            self._reset()
        new = list(new - self.known.keys())
        if not new:
            return
        ids, counts = self.index.encode([w.encode() for w in new])
        ids, at = ids.tolist(), 0
        tokens, number = self.vocabulary.token_bytes, self.number
        for word, n in zip(new, counts.tolist()):
            own = ids[at : at + n]
            at += n
            self.known[word] = ",".join([number[i] for i in own])
            self.decoded[word] = b"".join([tokens[i] for i in own]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        lists = list(self.words(text))
        self.learn(lists)
        return [int(i) for some in lists for w in some for i in self.known[w].split(",")]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class _Digest:
    """Counts and hashes of one document's ids and decoded text."""

    def __init__(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: str, text: str) -> None:
        self.ids.update((f",{ids}" if self.n else ids).encode())
        self.n += ids.count(",") + 1
        self.text.update(text.encode())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: how many tokens it has, the SHA-256 of its decimal ids joined by commas, and
    that of the text decoded from them.

    Special strings in a text become their own token, as the tokenizer's library has it. A null
    text is empty: no tokens, hashes of nothing. doc_id may be null or repeated: one row for each
    row. Extra columns are ignored; no rows give no rows. ``path``: a .json tokenizer file, read
    on the driver; its tables go to the executors (their size is the vocabulary's).
    """
    tables = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            rows = [_Digest() for _ in range(batch.num_rows)]
            waiting: list[tuple[_Digest, list[str]]] = []
            held = 0

            def flush() -> None:
                codec.learn([w for _, w in waiting])
                known, decoded = codec.known.__getitem__, codec.decoded.__getitem__
                for row, words in waiting:
                    row.add(",".join(map(known, words)), "".join(map(decoded, words)))
                waiting.clear()

            for row, text in zip(rows, batch.column(1)):
                for words in codec.words(text.as_py() or ""):
                    waiting.append((row, words))
                    held += sum(map(len, words)) if len(words) < 1000 else 6 * len(words)
                    if held > GROUP_CHARS:
                        flush()
                        held = 0
            flush()
            yield pa.record_batch([batch.column(0), pa.array([r.n for r in rows], pa.int64()), pa.array([r.ids.hexdigest() for r in rows]), pa.array([r.text.hexdigest() for r in rows])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document, for training."""
    tables = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t.as_py() or "" for t in part.column(1)]
                codec.learn([w for t in texts for w in codec.words(t)])
                yield pa.record_batch([part.column(0), pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of ``encoded``; null ids give a null text."""
    tables = ids.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tables.value.token_bytes
        for batch in batches:
            texts = [None if x.as_py() is None else b"".join(map(tokens.__getitem__, x.as_py())).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
