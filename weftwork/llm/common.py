"""Helpers that the training-data operators share: tables in the shared folder, Arrow
text buffers, and hashes of byte or word sequences held in numpy arrays."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One slice of numpy work: larger batches are cut so a worker's arrays stay small.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; only where
    it is unset (local tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "weftwork-checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what is planned and run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: For tables whose rows are some MB each: row groups of few rows (else Parquet's writer holds 100 rows before
#: it looks at their size, and its reader takes a row group at a time), and reads of few rows at a time.
WIDE_WRITE = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
WIDE_READ = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.parquet.columnarReaderBatchSize": "2"}


def materialize(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts the lineage, survives
    lost executors and keeps several consumers from computing it again. The shuffle files of the
    write are removed after it. ``options`` are the writer's."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(df.sparkSession)}/weftwork-{tag}-{uuid.uuid4().hex}", conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftwork_path = path
    return out


def tune(spark: SparkSession, rows: int = 2000, read: int = 512) -> None:
    """Keeps Arrow batches and the Parquet reader's batches of whole texts small, so that neither the
    JVM nor Python needs large arrays; lower settings of the session's own stay."""
    for key, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.parquet.columnarReaderBatchSize", "4096", read)):
        if not 0 < int(spark.conf.get(key, usual)) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that a Python worker no longer uses back, before its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(spark: SparkSession) -> None:
    """For loops that plan many jobs: has the driver's JVM collect what finished plans left, as Spark itself does every
    half hour (spark.cleaner.periodicGC.interval), so that its heap does not grow with the rounds. Spark then also removes
    the broadcasts and shuffle files that nothing uses any more."""
    spark._jvm.System.gc()


def row_key() -> list:
    """(doc_id, hash of the text): tells rows apart whose doc_id is null or shared, for filters that
    judge a row by its text alone; rows that agree in both are judged alike."""
    return [F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))]


def discard(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote and no later step reads."""
    path = getattr(df, "_weftwork_path", None)
    if path:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole column: one pruned scan, used to size partitions."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column)).cast("bigint")), F.lit(0))).first()[0]


def parts(total: int, each: int, least: int = 1) -> int:
    """Partitions of about ``each`` bytes."""
    return max(least, -(-total // each))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy per row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row): runs of whole rows of about ``most`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def small(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut at whole rows into parts with about ``most`` bytes of the text column."""
    for batch in batches:
        _, at = buffers(batch.column(column))
        for i, j in slices(at, most):
            yield batch.slice(i, j - i)


def _odd(seed: int) -> np.uint64:
    return np.uint64((seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF)


#: Base of the polynomial over 64-bit words, its inverse, and a value for each byte.
BASE = _odd(0x4F1BBCDCBFA53E0A)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        m = max(n + 1, 4096)
        up, down = np.full(m, BASE, np.uint64), np.full(m, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Sequence:
    """Hashes of any run of a sequence of 64-bit symbols, equal for equal runs anywhere."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Of each run of ``length`` symbols, by its start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs [start, end); the length counts."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words up to each row): the maximal runs of word bytes, which no run
    carries over a row's end."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1] | edge[1:n]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def runs_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs [start, start + length), one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings that lie one after another in ``data``; sizes are in bytes."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    wide = at[-1] >= 1 << 31
    buffers_ = [None, pa.py_buffer(at.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(sizes), buffers_)


def distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, first place of each number, bytes of each number): words are told apart
    by their bytes; numbers count up in the order of first places. Words do not overlap."""
    size = end - start
    coded = binary(raw[runs_of(start, size)], size).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    seen = np.maximum.accumulate(index) if len(index) else index
    first = np.flatnonzero(np.append(True, seen[1:] > seen[:-1])) if len(index) else np.zeros(0, np.int64)
    return index, first, coded.dictionary


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of each word, computed once for each distinct word of the batch."""
    from xxhash import xxh64_intdigest as digest

    index, _, words = distinct_words(raw, start, end)
    return np.fromiter(map(digest, words.to_pylist()), np.uint64, len(words))[index]


def is_word_table(pattern: str) -> np.ndarray:
    """A table of 256: which bytes are of a word. 'space' splits at ASCII white space,
    'alnum' keeps digits, letters and all bytes from 0x80."""
    table = np.ones(256, bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            table[a:b] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table
