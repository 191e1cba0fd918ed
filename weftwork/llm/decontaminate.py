"""Benchmark decontamination by a stored positional inverted index of the documents.

The index is a table with one row per shard, some MB of whole documents: the shard's distinct words,
how often each occurs, and the positions of all occurrences, list after list. It is written once to
the shared folder. A benchmark's windows of WINDOW consecutive words are the test phrases. Corpus
frequencies come from the stored counts. In each shard a phrase starts from the positions of its
rarest word, less the word's offset in the phrase; the lists of its other words, adjusted by their
offsets, are intersected with them from the rarest to the commonest. What is left are exact
occurrences. ``proximity`` counts, around the rarest words, which words of a phrase have a position
nearby.

Postings stay in their shard and nothing of them is shuffled. Of the benchmark, blocks of bounded
size go to all executors, one after another; each reads the index, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_READ, WIDE_WRITE, buffers, discard, distinct_words, is_word_table, lower_table, materialize, release, row_key, runs_of, settings, small, tune, word_bounds
from .repeats import spans

WINDOW = 13
#: Bytes of benchmark texts that go to the executors at a time; more go in further blocks.
BLOCK_BYTES = 4 << 20
#: Places that are intersected at a time.
AT_ONCE = 1 << 20
#: Bytes of text that a shard of the index has, at whole documents.
SHARD_BYTES = 2 << 20
INDEX = "shard bigint, doc array<bigint>, hash array<bigint>, ends array<int>, words array<binary>, counts array<int>, positions array<int>"


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each lower-cased word, bytes of each number, words up to each text)."""
    raw = lower_table()[raw]
    start, end, rows = word_bounds(is_word_table("alnum")[raw], at)
    index, _, words = distinct_words(raw, start, end)
    return index.astype(np.int64), words, rows


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of ``docs``: INDEX, one row per shard. ``ends`` has the words up
    to the end of each document; positions count the words of the shard. ``hash`` tells documents
    apart whose doc_id is null or shared."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in small(batches, 2, SHARD_BYTES):
            number, words, rows = words_of(*buffers(batch.column(2)))
            order = np.argsort(number, kind="stable").astype(np.int32)
            counts = np.bincount(number, minlength=len(words)).astype(np.int32)
            lists = batch.column(0), batch.column(1), pa.array(rows[1:].astype(np.int32)), words.cast(pa.binary()), pa.array(counts), pa.array(order)
            yield pa.record_batch([pa.array([shard]), *map(_one, lists)], names=names)
            shard += 1
            release()

    doc, text_hash = row_key()
    return docs.select(doc.alias("doc"), text_hash.alias("hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def stored(docs: DataFrame) -> DataFrame:
    """The index, written to the shared folder. A row has the postings of some MB of text, so row groups are small;
    it is read under WIDE_READ, else one batch would hold all shards of a task."""
    tune(docs.sparkSession)
    return materialize(index(docs), "postings", WIDE_WRITE)


@dataclass
class Phrases:
    """The distinct windows of a block of items: rows of word numbers, -1 beyond a short one's end."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # (phrase, place)
    size: np.ndarray
    owner_at: np.ndarray  # owners of phrase p: owners[owner_at[p] : owner_at[p + 1]]
    owners: np.ndarray
    order: np.ndarray | None = None  # places of each phrase's words, the corpus's rarest first

    @staticmethod
    def of(items: list[tuple[int, str | None]], window: int) -> Phrases:
        texts = [(t or "").encode() for _, t in items]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        number, words, rows = words_of(raw, at)
        n = np.diff(rows)
        count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        start, item = runs_of(rows[:-1], count), np.repeat(np.arange(len(items)), count)
        size = np.minimum(window, n)[item]
        place = np.arange(window)
        table = np.where(place < size[:, None], np.append(number, [0] * window)[start[:, None] + place], -1).astype(np.int32)
        table, phrase = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        ids = np.array([i for i, _ in items], np.int64)[item]
        pairs = np.unique(np.stack([phrase.reshape(-1), ids], 1), axis=0) if len(ids) else np.zeros((0, 2), np.int64)
        return Phrases({w: i for i, w in enumerate(words.to_pylist())}, table, (table >= 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(table) + 1)), pairs[:, 1])

    def rarest_first(self, frequency: np.ndarray) -> None:
        seen = np.where(self.words >= 0, np.append(frequency, 0)[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(seen, axis=1, kind="stable").astype(np.int16)

    def items(self, phrases: np.ndarray) -> np.ndarray:
        phrases = np.unique(phrases)
        return np.unique(self.owners[runs_of(self.owner_at[phrases], self.owner_at[phrases + 1] - self.owner_at[phrases])])


class Shard:
    """The postings of one row of the index for the words of a block of phrases."""

    def __init__(self, row: dict[str, pa.Array], phrases: Phrases):
        self.phrases = phrases
        known = phrases.vocabulary
        numbers = np.array([known.get(w, -1) for w in row["words"].to_pylist()], np.int64)
        counts = row["counts"].to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(counts) - counts
        have = np.flatnonzero(numbers >= 0)
        have = have[np.argsort(numbers[have], kind="stable")]
        self.count = np.zeros(len(known) + 1, np.int64)
        self.count[numbers[have]] = counts[have]
        self.at = np.cumsum(self.count) - self.count
        self.positions = row["positions"].to_numpy(zero_copy_only=False)[runs_of(begin[have], counts[have])].astype(np.int64)
        self.ends = np.append(0, row["ends"].to_numpy(zero_copy_only=False)).astype(np.int64)
        #: All lists as one sorted list of (word, position).
        self.span = int(self.ends[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.count)), self.count) * self.span + self.positions

    def places(self, phrase: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position) for all positions of each phrase's ``word``, some at a time."""
        n = self.count[word]
        cuts = np.searchsorted(np.cumsum(n), np.arange(AT_ONCE, int(n.sum()) + AT_ONCE, AT_ONCE), "right")
        for s, e in zip(np.append(0, cuts), np.append(cuts, len(n))):
            if e > s:
                yield np.repeat(phrase[s:e], n[s:e]), self.positions[runs_of(self.at[word[s:e]], n[s:e])]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first position) of all exact occurrences within a document."""
        own, out = self.phrases, []
        alive = np.flatnonzero((self.count[own.words] > 0).sum(1) == own.size) if len(own.size) else np.zeros(0, np.int64)
        rarest = own.order[alive, 0].astype(np.int64) if len(alive) else alive
        for phrase, place in self.places(alive, own.words[alive, rarest].astype(np.int64)):
            start = place - own.order[phrase, 0]
            row = np.searchsorted(self.ends, place, "right") - 1
            ok = (start >= self.ends[row]) & (start + own.size[phrase] <= self.ends[row + 1])
            phrase, start = phrase[ok], start[ok]
            for k in range(1, own.words.shape[1]):
                more = own.size[phrase] > k
                offset = own.order[phrase, k].astype(np.int64)
                wanted = np.where(more, own.words[phrase, offset], 0).astype(np.int64) * self.span + start + offset
                found = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
                phrase, start = phrase[found | ~more], start[found | ~more]
                if not len(phrase):
                    break
            out.append((phrase, start))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, within: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, position, words): the places around which at least ``share`` of a phrase's distinct
        words occur. So many rarest words are looked at that one of them cannot be missing."""
        own = self.phrases
        first = np.ones(own.words.shape, bool)  # repeats of a word within its phrase do not count
        for k in range(1, own.words.shape[1]):
            first[:, k] = (own.words[:, k] >= 0) & (own.words[:, :k] != own.words[:, k : k + 1]).all(1)
        distinct = first.sum(1)
        enough = np.maximum(1, np.ceil(share * distinct - 1e-9)).astype(np.int64)
        lists, owners = [], []
        tried = np.zeros(len(own.size), np.int64)
        for k in range(own.words.shape[1]):
            offset = own.order[:, k].astype(np.int64)
            use = first[np.arange(len(offset)), offset] & (tried <= distinct - enough)
            tried += use
            owners.append(np.flatnonzero(use)), lists.append(own.words[use, offset[use]].astype(np.int64))
        for phrase, place in self.places(np.concatenate(owners), np.concatenate(lists)):
            row = np.searchsorted(self.ends, place, "right") - 1
            low, high = np.maximum(self.ends[row], place - within), np.minimum(self.ends[row + 1], place + within + 1)
            n = np.zeros(len(phrase), np.int64)
            for k in range(own.words.shape[1]):
                word = own.words[phrase, k].astype(np.int64)
                met = np.searchsorted(self.keys, word * self.span + low) < np.searchsorted(self.keys, word * self.span + high)
                n += met & first[phrase, k]
            ok = n >= enough[phrase]
            yield phrase[ok], place[ok], n[ok]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(k)[i] for k, f in enumerate(batch.schema)}
            yield row["shard"].as_py(), {k: v.values for k, v in row.items() if k != "shard"}


def _pieces(text: str, most: int, window: int) -> Iterator[str]:
    """A text, or parts of it that share ``window`` - 1 words, so every window is in one of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) <= most:
        yield text
        return
    start, end, _ = word_bounds(is_word_table("alnum")[raw], np.array([0, len(raw)]))
    i = 0
    while True:
        j = max(i + window, int(np.searchsorted(end, start[i] + most, "right"))) if len(start) else 0
        yield raw[start[i] : end[min(j, len(end)) - 1]].tobytes().decode("utf-8", "replace") if len(start) else ""
        if j >= len(start):
            return
        i = j - window + 1


def blocks(benchmark: DataFrame, window: int, most: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The phrases of the items, for about ``most`` bytes of text at a time."""
    rows, held = [], 0
    for row in benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        for piece in _pieces(row.text or "", most, window):
            if held and held + 4 * len(piece) > most:
                yield Phrases.of(rows, window)
                rows, held = [], 0
            rows.append((row.item_id, piece))
            held += len(piece.encode())
    yield Phrases.of(rows, window)


def _ordered(postings: DataFrame, phrases: Phrases) -> None:
    """Orders the words of the phrases by their frequency in the corpus, from the stored counts; as
    many numbers as the block has words come to the driver."""
    shared = postings.sparkSession.sparkContext.broadcast(phrases.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for _, row in _shards(batches):
            numbers = np.array([known.get(w, -1) for w in row["words"].to_pylist()], np.int64)
            np.add.at(total, numbers, row["counts"].to_numpy(zero_copy_only=False))
        met = np.flatnonzero(total[:-1])
        yield pa.record_batch([pa.array(met), pa.array(total[met])], ["word", "n"])

    counted = postings.select("shard", "words", "counts").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(phrases.vocabulary), np.int64)
    frequency[counted.word.to_numpy(np.int64)] = counted.n.to_numpy(np.int64)
    phrases.rarest_first(frequency)
    shared.unpersist()


SCHEMA = "doc_id bigint, hash bigint, shard bigint, row int, n_words bigint, hits array<int>, items array<bigint>"


def _hits(postings: DataFrame, phrases: Phrases) -> DataFrame:
    _ordered(postings, phrases)
    shared = postings.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, row in _shards(batches):
            own = Shard(row, shared.value)
            phrase, start = own.occurrences()
            ends, n = own.ends, len(row["doc"])
            mask = spans(start, own.phrases.size[phrase], int(ends[-1]))
            at = np.searchsorted(ends, start, "right") - 1
            hits = [np.zeros(0, np.int32)] * n
            items = [np.zeros(0, np.int64)] * n
            order = np.argsort(at, kind="stable")
            touched, first = np.unique(at[order], return_index=True)
            for r, s, e in zip(touched.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                items[r] = own.phrases.items(phrase[order[s:e]])
                step = np.diff(np.concatenate([[0], mask[ends[r] : ends[r + 1]].view(np.int8), [0]]))
                hits[r] = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).reshape(-1).astype(np.int32)
            columns = row["doc"], row["hash"], pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(ends)), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))
            yield pa.record_batch(list(columns), names=[c.split()[0] for c in SCHEMA.split(", ")])
            release()

    return postings.mapInArrow(run, SCHEMA)


def _united(runs: pd.Series) -> pd.Series:
    """Of each row's lists of runs [start, end, ...] the runs of their union."""

    def one(parts):
        out: list[int] = []
        for s, e in sorted((int(p[i]), int(p[i + 1])) for p in parts for i in range(0, len(p), 2)):
            if out and s <= out[-1]:
                out[-1] = max(out[-1], e)
            else:
                out += [s, e]
        return out

    return runs.map(one)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, hash of its text, words, hit runs of words as [start, end, ...], and the
    items with windows in it.

    Words are runs of digits, letters and bytes from 0x80, A-Z lower-cased. An item of fewer than
    ``window`` words is one window; one without words has none. Null texts have no words; items
    with a null id are left out; repeated items count once. doc_id may be null or repeated: one row
    for each row. Extra columns are ignored, whatever their names; an empty benchmark hits nothing,
    and no rows give no rows. A benchmark beyond BLOCK_BYTES is searched block by block in the same
    index, and the runs are united.
    """
    postings, found = stored(docs), []
    for phrases in blocks(benchmark, window):
        with settings(docs.sparkSession, WIDE_READ):
            found.append(materialize(_hits(postings, phrases), "hits"))
    discard(postings)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if len(found) > 1:
        grouped = every.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        every = grouped.withColumn("hits", F.pandas_udf(_united, "array<int>")("hits"))
    return every.select("doc_id", "hash", "n_words", "hits", "items")


def n_hit(hits) -> F.Column:
    """Words in the runs [start, end, ...]."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Adds to ``matches`` the number of hit words and whether the document is contaminated: it has
    hits, and at least one word in ``share`` is hit."""
    found = matches(docs, benchmark, window).withColumn("n_hit", n_hit(F.col("hits")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Each row is judged by
    its own text, whether its doc_id is null, shared or neither; rows without words stay."""
    bad = contamination(docs, benchmark, window, share).where("contaminated").select("doc_id", "hash").distinct()
    doc, text_hash = row_key()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("doc"), text_hash.alias("own"))
    kept = rows.join(bad, rows.doc.eqNullSafe(bad.doc_id) & (rows.own == bad.hash), "left_anti")
    return kept.select("row.*")


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = 40, share: float = 0.8, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, position, words): documents that have, within ``within`` words around one of
    a phrase's words, at least ``share`` of its distinct words, in any order: the best count of each
    document and item, and the least position that has it. Nulls, repeats and empty tables as in
    ``matches``; rows that share a doc_id give a row each."""
    postings, out = stored(docs), None
    schema = "shard bigint, row int, doc_id bigint, item_id bigint, position bigint, words bigint"
    for phrases in blocks(benchmark, window):
        with settings(docs.sparkSession, WIDE_READ):
            _ordered(postings, phrases)
        shared = postings.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for shard, row in _shards(batches):
                own = Shard(row, shared.value)
                p = own.phrases
                for phrase, place, n in own.near(within, share):
                    count = p.owner_at[phrase + 1] - p.owner_at[phrase]
                    item = p.owners[runs_of(p.owner_at[phrase], count)]
                    place, n = np.repeat(place, count), np.repeat(n, count)
                    at = np.searchsorted(own.ends, place, "right") - 1
                    order = np.lexsort((place, -n, item, at))
                    best = order[np.flatnonzero(np.append(True, (np.diff(item[order]) != 0) | (np.diff(at[order]) != 0)))] if len(order) else order
                    ids = row["doc"].take(pa.array(at[best]))
                    columns = pa.array(np.full(len(best), shard)), pa.array(at[best].astype(np.int32)), ids, pa.array(item[best]), pa.array(place[best] - own.ends[at[best]]), pa.array(n[best])
                    yield pa.record_batch(list(columns), names=[c.split()[0] for c in schema.split(", ")])

        with settings(docs.sparkSession, WIDE_READ):
            some = materialize(postings.mapInArrow(run, schema), "near")
        out = some if out is None else out.unionByName(some)
    best = F.max(F.struct("words", (-F.col("position")).alias("p"))).alias("best")
    return out.groupBy("shard", "row", "item_id").agg(F.first("doc_id").alias("doc_id"), best).select("doc_id", "item_id", (-F.col("best.p")).alias("position"), F.col("best.words").alias("words"))
