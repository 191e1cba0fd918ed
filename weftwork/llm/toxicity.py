"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, looked
up by hash; so a misspelling shares most of the vectors of the word it stands for. A document's
vector is the average over its words; as an average alone dilutes what a long text holds in one
place, the average over its worst pair of neighbouring words (at any place) counts as well. A linear
softmax scores both. Vectors and softmax are trained jointly by gradient descent in numpy in one
task, on a bounded sample of labelled documents: at most ``per_class`` of each label, those with
the least hash of their id, of at most ``sample_bytes`` bytes each. Scoring covers whole texts of
all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, Sequence, buffers, distinct_words, is_word_table, lower_table, release, runs_of, small, word_bounds

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 8, (3, 4, 5, 6)
#: Words of a window; factors of a document's average and of its worst window's.
WINDOW, AVERAGE, WORST = 2, 8.0, 4.0
PER_CLASS, SAMPLE_BYTES, MET, THRESHOLD = 1000, 32768, 5, 0.7
OPEN, CLOSE = np.uint8(0x02), np.uint8(0x03)


def split(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start and end of each word, words up to each text)."""
    raw = lower_table()[raw]
    return raw, *word_bounds(is_word_table("alnum")[raw], at)


def subwords(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): the buckets of each word's n-grams, its ends marked, and of the word."""
    size = end - start + 2
    offset = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(total) - offset[owner]
    marked = raw[np.clip(start[owner] + inner - 1, 0, max(0, len(raw) - 1))] if len(raw) else np.zeros(total, np.uint8)
    marked = np.where(inner == 0, OPEN, np.where(inner == size[owner] - 1, CLOSE, marked))
    values = Sequence(BYTE_VALUE[marked])
    left = size[owner] - inner
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    words, buckets = [np.arange(len(size), dtype=np.int32)], [(values.runs(offset, offset + size) >> shift).astype(np.int32)]
    for n in GRAMS:
        grams = values.fixed(n)
        ok = np.flatnonzero((left[: len(grams)] >= n) & (size[owner[: len(grams)]] > n))
        words.append(owner[ok].astype(np.int32)), buckets.append((grams[ok] >> shift).astype(np.int32))
    return np.concatenate(words), np.concatenate(buckets)


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window: WINDOW neighbouring words, or a shorter text's all."""
    n = np.diff(rows)
    count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    return runs_of(rows[:-1], count), np.minimum(WINDOW, n)[text], text


def pooled(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of ``words`` over each run [start, start + size)."""
    upto = np.append(0, np.cumsum(words))
    return (upto[start + size] - upto[start]) / size


@dataclass
class Model:
    """``vectors``: one a bucket; ``weights``: of the two classes; ``bias``: of their difference."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float

    def word_logits(self, words: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """What each of ``n`` words adds to the difference of the two logits, as the mean of its vectors does."""
        own = self.vectors @ (self.weights[1] - self.weights[0])
        return np.bincount(words, own[buckets], n) / np.maximum(1, np.bincount(words, minlength=n))


def document_logits(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The difference of the logits of each text, but for the bias, from what its words add: the
    average of all, and that of the worst window. Texts without words get 0."""
    out = np.zeros(len(rows) - 1)
    has = np.flatnonzero(np.diff(rows) > 0)
    if len(has):
        begin, size, text = windows(rows)
        out[has] = WORST * np.maximum.reduceat(pooled(words, begin, size), np.searchsorted(text, has)) + AVERAGE * pooled(words, rows[has], np.diff(rows)[has])
    return out


def softmax_toxic(logit: np.ndarray) -> np.ndarray:
    """The second class's share of a softmax over two logits that differ by ``logit``."""
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 120, rate: float = 0.6, decay: float = 2e-4, seed: int = 7) -> Model:
    """Fits vectors and softmax to the sample. With one class only, scores are all 0 or all 1."""
    labels = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1, (2, DIMENSIONS)) / np.sqrt(DIMENSIONS)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    if not len(labels) or labels.min() == labels.max():
        return Model(vectors, weights, 30.0 if len(labels) and labels[0] else -30.0)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw, start, end, rows = split(raw, at)
    word, first, _ = distinct_words(raw, start, end)
    owner, bucket = subwords(raw, start[first], end[first])
    per_word = 1 / np.bincount(owner)
    # Buckets that few texts use cannot tell anything; their vectors stay zero.
    text_of_word = np.repeat(np.arange(len(texts)), np.diff(rows))
    met = np.unique(word.astype(np.int64) * len(texts) + text_of_word) // len(texts)
    frequent = np.bincount(bucket, np.bincount(met, minlength=len(first))[owner], BUCKETS) >= MET
    owner, bucket = owner[frequent[bucket]], bucket[frequent[bucket]]
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    column = np.searchsorted(used, bucket).astype(np.int32)
    del bucket, frequent, met, text_of_word
    begin, size, text = windows(rows)
    has = np.flatnonzero(np.diff(rows) > 0)
    text_first, own_text = np.searchsorted(text, has), np.searchsorted(has, text)
    length = np.diff(rows)[has]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    small_vectors, bias = np.zeros((len(used), DIMENSIONS)), 0.0
    speed, w_speed, b_speed = np.zeros_like(small_vectors), np.zeros_like(weights), 0.0
    for turn in range(rounds):
        direction = weights[1] - weights[0]
        own = small_vectors @ direction
        each = (np.bincount(owner, own[column], len(first)) * per_word)[word]
        seg = WORST * pooled(each, begin, size)
        # At first all windows of a document share its gradient, in the end the worst ones take it.
        sharp = 30 * max(0.0, turn / rounds - 0.1)
        worst = np.maximum.reduceat(seg, text_first)
        share = np.exp(sharp * (seg - worst[own_text]))
        share /= np.add.reduceat(share, text_first)[own_text]
        mean = AVERAGE * pooled(each, rows[has], length)
        error = (softmax_toxic(np.add.reduceat(share * seg, text_first) + mean + bias) - labels[has]) * weight[has]
        g_seg = error[own_text] * share / size * WORST
        edge = np.bincount(begin, g_seg, len(word) + 1) - np.bincount(begin + size, g_seg, len(word) + 1)
        g_each = np.cumsum(edge)[:-1] + np.repeat(error / length * AVERAGE, length)
        g_word = np.bincount(word, g_each, len(first)) * per_word
        g_own = np.bincount(column, g_word[owner], len(used)) / len(has)
        g_weights = g_own @ small_vectors
        speed = 0.9 * speed + np.outer(g_own, direction) + decay * small_vectors
        w_speed = 0.9 * w_speed + np.stack([-g_weights, g_weights])
        b_speed = 0.9 * b_speed + error.mean()
        scale = rate / max(1e-9, np.sqrt((speed**2).sum()))
        small_vectors -= min(scale, 200.0) * speed
        weights -= 0.02 * w_speed
        bias -= 0.1 * b_speed
    vectors[used] = small_vectors
    own = small_vectors @ (weights[1] - weights[0])
    each = (np.bincount(owner, own[column], len(first)) * per_word)[word]
    border = boundary(document_logits(each, rows)[has], labels[has])
    return Model(vectors, weights, float(np.log(THRESHOLD / (1 - THRESHOLD)) - border))


def boundary(logits: np.ndarray, labels: np.ndarray) -> float:
    """The border of the two classes that has the fewest errors in the sample, in the middle of
    where it can lie, and above what words that no sample has score (0); the bias is set so that it
    gets the score THRESHOLD."""
    order = np.argsort(logits, kind="stable")
    logits, labels = logits[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(labels)]) + (labels == 0).sum() - np.concatenate([[0], np.cumsum(labels == 0)])
    errors[1:-1][logits[1:] == logits[:-1]] = len(labels) + 1  # equal scores are not told apart
    best = np.flatnonzero(errors == errors.min())
    i = int(best[len(best) // 2])
    edges = np.concatenate([[logits[0] - 1], logits, [logits[-1] + 1]])
    return max(0.25, float((edges[i] + edges[i + 1]) / 2))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, toxic, h, text): the training sample, h its order. ``labels`` (doc_id, toxic) picks the documents. A
    document labelled twice counts as toxic if one label says so; null labels are left out; of texts that share a
    doc_id the least is taken. Only ids are shuffled to pick the sample."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
    met = rows.select("doc_id").join(known, "doc_id").distinct().withColumn("h", F.xxhash64("doc_id"))
    picked = [met.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class rows at most
    return rows.join(chosen, "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))


SCHEMA = "doc_id bigint, score double, predicted int"


def _scorer(docs: DataFrame, model: Model):
    """A function from a text column to its scores, for use in tasks; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors.astype(np.float32, copy=False), model.weights, model.bias))

    def scores(column: pa.Array) -> np.ndarray:
        own = Model(*shared.value)
        raw, start, end, rows = split(*buffers(column))
        logit = np.zeros(len(column))
        if len(start):
            word, first, _ = distinct_words(raw, start, end)
            logit = document_logits(own.word_logits(*subwords(raw, start[first], end[first]), len(first))[word], rows)
        p = softmax_toxic(logit + own.bias)
        if own.bias < 20:  # else all labels were toxic
            p[np.diff(rows) == 0] = 0.0
        return p

    return scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document, from its whole text alone.

    A null, empty or wordless text scores 0 (1 if all known labels are toxic). doc_id may be null or repeated: one
    row for each row. Extra columns are ignored; no rows give no rows.
    """
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            p = scores(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


#: A model as a row: numbers and vectors of the buckets that are not zero.
MODEL = "at binary, vectors binary, weights binary, bias double"


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of ``sample``."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "toxic", "text")))]
    rows.sort(key=lambda r: r[:2])
    model = train([r[3].encode() for r in rows], np.array([r[2] for r in rows], np.int64))
    at = np.flatnonzero(model.vectors.any(axis=1)).astype(np.int32)
    out = (at.tobytes(), model.vectors[at].astype(np.float32).tobytes(), model.weights.tobytes(), model.bias)
    del rows, model
    release()
    yield pa.record_batch([pa.array([x]) for x in out], ["at", "vectors", "weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    """Trains on labelled documents that are not held out, in one task, as the sample is bounded; the driver gets the
    vectors that are not zero and no text."""
    row = sample(docs, labels.where(~held_out(F.col("doc_id"))), **bounds).repartition(1).mapInArrow(_train_rows, MODEL).first()
    if row is None:  # no rows, no task
        return train([], np.zeros(0))
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    vectors[np.frombuffer(row.at, np.int32)] = np.frombuffer(row.vectors, np.float32).reshape(-1, DIMENSIONS)
    return Model(vectors, np.frombuffer(row.weights).reshape(2, DIMENSIONS), row.bias)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns. Each row is
    judged by its own text, whether its doc_id is null, shared or neither; rows without words stay
    (unless all known labels are toxic). No rows give no rows."""
    scores, at = _scorer(docs, fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at):
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
