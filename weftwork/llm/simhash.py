"""Near-duplicates by SimHash fingerprints that Golay-code keys bring together.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The binary Golay code
[23, 12, 7] is perfect: every word of 23 bits lies within 3 errors of exactly one codeword. Two
words that differ in at most 2 bits have a common neighbour, whose codeword is within 4 errors of
both; so if a word's keys are all codewords within 4 errors (1 or 6 of them), two such words share
a key. With at most 2 differing bits in all, one of the three segments is equal (pigeonhole) and
the next one has at most 2 errors. A join key is therefore (segment number, its exact bits, one
codeword index of the next segment): about 16 keys a fingerprint, of 30 to 35 bits each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, buffers, discard, is_word_table, lower_table, materialize, mix, release, runs_of, small, tidy, tune, word_bounds
from .components import connected_components, stars

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Larger buckets are keyed by the third segment's codewords too.
BUCKET = 64
#: Bands of a set of shingles, and minima of each.
BANDS, BAND = 24, 4
#: Bits of the map of a set of shingles.
MAP = 1024
#: Texts of more bytes have no list of words made; shingles that are hashed at a time.
LONG, AT_ONCE = 1 << 20, 1 << 15
_tables: dict[str, np.ndarray] = {}


def golay_index() -> np.ndarray:
    """The index of the nearest codeword of each of the 2**23 words."""
    if "index" not in _tables:
        generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 - 1
        codes = np.zeros(1, np.uint32)
        for k in range(12):
            codes = np.concatenate([codes, codes ^ np.uint32(generator << k)])
        bits = np.uint32(1) << np.arange(23, dtype=np.uint32)
        one = bits
        two = np.concatenate([bits[i] ^ bits[i + 1 :] for i in range(22)])
        three = np.concatenate([bits[i] ^ bits[j] ^ bits[j + 1 :] for i in range(21) for j in range(i + 1, 22)])
        index = np.zeros(1 << 23, np.uint16)
        for e in np.concatenate([np.zeros(1, np.uint32), one, two, three]):
            index[codes ^ e] = np.arange(4096, dtype=np.uint16)
        _tables["index"] = index
    return _tables["index"]


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, codeword index): all codewords within 4 errors of each 23-bit word."""
    index = golay_index()
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(23, dtype=np.uint32)])
    near = np.sort(index[words.astype(np.uint32)[:, None] ^ flips], axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(fresh)[0], near[fresh].astype(np.int64)


def segment(fps: np.ndarray, i: int) -> np.ndarray:
    at, width = SEGMENTS[i]
    return (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``k`` words, joined by one space, some at a time; of all words if they
    are fewer. Words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest as digest

    if len(text) > LONG:  # no list of words
        raw = lower_table()[np.frombuffer(text, np.uint8)]
        start, end, _ = word_bounds(is_word_table("space")[raw], np.array([0, len(raw)]))
        size = end - start + 1
        body = np.append(raw, np.uint8(0x20))[runs_of(start, size)]
        ends = np.cumsum(size) - 1
        body[ends] = 0x20
        joined, starts = memoryview(body), ends - size + 1
    else:
        words = text.lower().split()
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([np.zeros(min(1, len(words)), np.int64), ends[:-1] + 1])
    if len(starts) > k:
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for i in range(0, len(starts), AT_ONCE):
        part = zip(starts[i : i + AT_ONCE].tolist(), ends[i : i + AT_ONCE].tolist())
        yield np.array([digest(joined[s:e], SEED) for s, e in part], np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for some in hashes:
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every document; a null or wordless text has fingerprint zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            raw, at = buffers(batch.column(1))
            raw = memoryview(raw)
            fps = np.array([majority(shingle_hashes(bytes(raw[s:e]), k)) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id bigint, fp bigint")


def _keyed(fps: DataFrame, fine: bool) -> DataFrame:
    """(key, sub, fp): the join keys of each fingerprint; ``fine`` adds the third segment's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(every), 1 << 14):
                some = every[a : a + (1 << 14)]
                keys, subs, rows = [], [], []
                for i in range(3):
                    row, code = golay_keys(segment(some, (i + 1) % 3))
                    key = (segment(some, i).astype(np.int64)[row] << 14) | (code << 2) | i
                    sub = np.zeros(len(row), np.int64)
                    if fine:
                        which, third = golay_keys(segment(some, (i + 2) % 3)[row])
                        row, key, sub = row[which], key[which], third + 1
                    keys.append(key), subs.append(sub), rows.append(row)
                at = np.concatenate(rows)
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(subs)), pa.array(some[at].view(np.int64))], ["key", "sub", "fp"])

    return fps.mapInArrow(scan, "key bigint, sub bigint, fp bigint")


def _pairs(members: DataFrame) -> DataFrame:
    a, b = members.select("key", "sub", F.col("fp").alias("a")), members.select("key", "sub", F.col("fp").alias("b"))
    return a.join(b, ["key", "sub"]).where("a < b and bit_count(a ^ b) <= 2").select("a", "b")


def _ball(dense: DataFrame) -> DataFrame:
    """Links without pairs: fingerprints within 2 bits share a word within 1 bit of both, and all
    that share such a word are within 2 bits; each links to the least that shares it."""
    point = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))))
    points = dense.select("fp", point.alias("w"))
    least = points.groupBy("w").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x")
    return points.join(least, "w").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs that
    differ in at most 2 bits. ``fps``: one bigint column ``fp`` without repeats.

    A bucket of up to BUCKET members is joined with itself and each pair verified. A larger one is
    keyed more finely by the third segment's codewords; members of buckets that stay larger are
    linked exactly through the words within one bit of them, which needs no pairs.
    """
    sizes = lambda keyed: keyed.groupBy("key", "sub").agg(F.count("*").alias("n")).where("n > 1")
    coarse = materialize(_keyed(fps, False), "keys")
    sized = materialize(coarse.join(sizes(coarse), ["key", "sub"]), "buckets")
    discard(coarse)
    found = _pairs(sized.where(F.col("n") <= BUCKET))
    hot = sized.where(F.col("n") > BUCKET).select("fp").distinct()
    keys = sized.where(F.col("n") > BUCKET).select("key").distinct()
    fine = _keyed(hot, True).join(keys, "key", "left_semi")
    fine_sized = materialize(fine.join(sizes(fine), ["key", "sub"]), "fine-buckets")
    found = found.union(_pairs(fine_sized.where(F.col("n") <= BUCKET)))
    return found.union(_ball(fine_sized.where(F.col("n") > BUCKET).select("fp").distinct()))


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: documents whose fingerprints differ in at
    most 2 bits are linked; the class is the least doc_id that links reach.

    Repeated texts share a fingerprint and count once in the search. A null, empty or wordless
    text has fingerprint zero, linked like any other. Rows with a null doc_id are left out; a
    doc_id that occurs twice gives two rows. Extra columns are ignored; no rows give no rows.
    """
    each = materialize(fingerprints(docs, k).where("doc_id is not null"), "fingerprints")
    classes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    return _components(each, classes, links(classes.select("fp")))


def _components(each: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that edges between fingerprints reach."""
    named = edges.join(classes.select(F.col("fp").alias("a"), F.col("least").alias("la")), "a").join(classes.select(F.col("fp").alias("b"), F.col("least").alias("lb")), "b")
    # A doc_id that occurs with two texts stands for both fingerprints and so joins them.
    parts = connected_components(named.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    mapped = classes.join(parts, classes.least == parts.node, "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return each.join(mapped, "fp").select("doc_id", "fp", "component_id")


def _sets(raw: memoryview, at: np.ndarray, k: int) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    """(distinct shingle hashes of each text, a hash of each set, its size)."""
    from xxhash import xxh64_intdigest as digest

    sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(bytes(raw[s:e]), k)])) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    fps = np.array([digest(x.tobytes(), SEED) for x in sets], np.uint64)
    return sets, pa.array(fps.view(np.int64)), pa.array([len(x) for x in sets], pa.int32())


def _lists(counts, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp, sim, n, keys, sig, map) of every document, from its distinct shingle hashes: a hash of them
    all, their SimHash fingerprint, how many they are, one key a band of BAND minima, each under a permutation of its own, 8 bits of
    each minimum, and a map of MAP bits with one bit set for each shingle."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = rng.integers(0, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, SLICE_BYTES):
            raw, at = buffers(batch.column(1))
            sets, fps, n = _sets(memoryview(raw), at, k)
            least = np.full((len(sets), BANDS * BAND), (1 << 64) - 1, np.uint64)
            bits = np.zeros((len(sets), MAP), bool)
            for i, some in enumerate(sets):
                bits[i, mix(some) % np.uint64(MAP)] = True
                for j in range(0, len(some), 1 << 12):
                    np.minimum(least[i], (factors[:, None] * some[j : j + (1 << 12)]).min(1), out=least[i])
            sims = np.array([majority(iter([x])) for x in sets], np.uint64)
            keys = mix((mix(least.reshape(-1, BANDS, BAND)) * weights).sum(2, dtype=np.uint64) + bands)
            sig = (mix(least) >> np.uint64(56)).astype(np.uint8).reshape(-1).view(np.int64)
            maps = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
            each = lambda size, values: _lists(np.full(len(sets), size), values)
            yield pa.record_batch([batch.column(0), fps, pa.array(sims.view(np.int64)), n, each(BANDS, keys.ravel()), each(BANDS * BAND // 8, sig), each(MAP // 64, maps)], ["doc_id", "fp", "sim", "n", "keys", "sig", "map"])
            del sets, least, keys, bits
            release()

    return _texts(docs).mapInArrow(scan, "doc_id bigint, fp bigint, sim bigint, n int, keys array<bigint>, sig array<bigint>, map array<bigint>")


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    """(fp, n, shingles) of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, SLICE_BYTES):
            raw, at = buffers(batch.column(1))
            sets, fps, n = _sets(memoryview(raw), at, k)
            yield pa.record_batch([fps, n, _lists([len(x) for x in sets], np.concatenate(sets) if sets else np.zeros(0, np.uint64))], ["fp", "n", "shingles"])
            release()

    return _texts(docs).mapInArrow(scan, "fp bigint, n int, shingles array<bigint>")


def _bits_apart(similarity: float) -> int:
    """Bits by which the signatures of two sets of that similarity differ at most: five standard
    deviations above the mean. Unequal minima have half of their 8 bits unequal."""
    m = BANDS * BAND
    unequal = m * (1 - similarity)
    return int(4 * unequal + 5 * (2 * unequal + 16 * m * similarity * (1 - similarity)) ** 0.5)


def _signed(signatures: DataFrame, x: str, *others) -> DataFrame:
    """The sets as one side ``x`` of a pair: a column of its own for each word of signature and map,
    none of them nullable: code with checks for nulls would be too long for the JVM to compile."""
    words = lambda name, short, n: [F.coalesce(F.col(name)[i], F.lit(0)).alias(f"{short}{x}{i}") for i in range(n)]
    return signatures.select(*others, F.col("fp").alias(x), F.col("n").alias(f"n{x}"), *words("sig", "g", BANDS * BAND // 8), *words("map", "m", MAP // 64))


def _near(similarity: float):
    """Whether sizes, signatures and maps of the sides ``a`` and ``b`` let two sets be that similar.

    Each bit that only one map has set stands for a shingle of that set at least that the other lacks,
    so the maps bound how many can be shared: exactly but for shingles that meet in one bit. That tells
    short texts apart that have a passage in common; it never rules out a link."""
    differ = sum((F.bit_count(F.col(f"ga{i}").bitwiseXOR(F.col(f"gb{i}"))) for i in range(BANDS * BAND // 8)), F.lit(0))
    lacks = lambda x, y: sum((F.bit_count(F.col(f"m{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"m{y}{i}")))) for i in range(MAP // 64)), F.lit(0))
    fits = lambda shared: shared * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("na") + F.col("nb")) - 1e-6
    return fits(F.least("na", "nb")) & (differ <= _bits_apart(similarity)) & fits(F.col("na") - lacks("a", "b")) & fits(F.col("nb") - lacks("b", "a"))


def _alike(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity, counted exactly, is ``similarity`` at least;
    shingles are made again, of one document a set, for pairs alone whose sizes and signatures allow it."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialize(pairs.join(_signed(signatures, "a"), "a").join(_signed(signatures, "b"), "b").where(_near(similarity)).select("a", "b"), "pairs")
    needed = both.select(F.col("a").alias("fp")).union(both.select("b")).distinct()
    # Written, so that Spark knows its size: texts are shuffled only where it is too large to be broadcast.
    some = materialize(classes.join(needed, "fp").select(F.col("least").alias("doc_id")).distinct(), "asked")
    texts = _texts(docs).join(some, "doc_id", "left_semi")
    used = materialize(_shingles(texts, k).join(needed, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    side = lambda x: used.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    out = both.join(side("a"), "a").join(side("b"), "b").where(shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared) - 1e-6)
    found = materialize(out.select("a", "b"), "alike")
    discard(both), discard(used), discard(some)
    tidy(docs.sparkSession)
    return found


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints differ in at most 2 bits, by their Golay keys. Sets of one
    fingerprint are paired with the least of them, which stands for it in pairs of fingerprints."""
    sims = materialize(sets.select("sim", "fp").distinct(), "simhash")
    least = materialize(sims.groupBy("sim").agg(F.min("fp").alias("least")), "simhash-least")
    own = sims.join(least, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    end = lambda x: least.select(F.col("sim").alias(x), F.col("least").alias(f"{x}f"))
    return links(least.select(F.col("sim").alias("fp"))).join(end("a"), "a").join(end("b"), "b").select(F.col("af").alias("a"), F.col("bf").alias("b")).union(own)


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every document: documents whose sets of ``k``-word shingles have
    a Jaccard similarity of ``similarity`` or more are linked; the class is the least doc_id that
    links reach. ``fp`` is a hash of the set.

    First come the pairs that SimHash finds: fingerprints of the sets within 2 bits, brought together by
    their Golay keys (``links``). Sets at 0.8 may differ in far more bits (about 10 of 64) than such keys
    can bridge, so for the sets that are not together yet further candidates come from BANDS bands of BAND minima
    of the sets: a pair at 0.8 shares none with a probability of 3e-6. A signature of 8 bits of each minimum and the sizes
    rule pairs out before their shingles are read (a pair at 0.8 with a probability below 1e-5); every
    link, of either kind, is verified by counting. In a bucket, members are compared with its least and greatest
    first, if not in one component with it; then the pairs that are not in one component yet are joined on the bucket and on classes of
    sizes, with sizes, signatures and maps as part of the join's condition, so a large group of copies
    needs no pairs within it and one of unlike texts gives no rows.

    Wordless texts have equal, empty sets. Rows with a null doc_id are left out; a doc_id that occurs
    twice gives two rows. Extra columns are ignored; no rows give no rows.
    """
    tune(docs.sparkSession)
    sets = materialize(shingle_sets(docs, k).where("doc_id is not null"), "shingles")
    each = materialize(sets.select("doc_id", "fp"), "fingerprints")
    classes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    signatures = materialize(sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("map").alias("map")), "signatures")
    close = _alike(_simhash_pairs(sets), signatures, docs, classes, k, similarity)
    parts = connected_components(close)
    keyed = sets.groupBy("fp").agg(F.first("keys").alias("keys")).join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    keyed = keyed.select("fp", F.coalesce("component", "fp").alias("c"), F.explode("keys").alias("key"))
    least, most = F.min(F.struct("fp", "c")), F.max(F.struct("fp", "c"))
    ends = keyed.groupBy("key").agg(least.alias("m"), most.alias("x")).where("m.fp < x.fp")
    buckets = materialize(keyed.join(ends, "key"), "buckets")
    discard(sets)
    star = buckets.where("c <> m.c").select(F.col("fp").alias("a"), F.col("m.fp").alias("b")).union(buckets.where("c <> x.c").select("fp", "x.fp"))
    # What is together goes on as stars: one edge a set in place of all its links.
    parts = connected_components(stars(parts).union(_alike(star, signatures, docs, classes, k, similarity)))
    members = materialize(buckets.select("key", "fp").join(parts, buckets.fp == parts.node, "left").select("key", "fp", F.coalesce("component", "fp").alias("c")), "members")
    discard(buckets)
    mixed = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = materialize(members.join(mixed, "key", "left_semi").join(signatures, "fp"), "mixed")
    # The greater set of a pair is of the lesser one's class of sizes or of the next.
    width = -math.log(similarity) + 1e-6
    sizes = F.floor(F.log(F.greatest("n", F.lit(1))) / width)
    a = _signed(left, "a", "key", F.col("c").alias("ca"), sizes.alias("s"))
    b = _signed(left, "b", F.col("key").alias("other"), F.col("c").alias("cb"), F.explode(F.array(sizes, sizes - 1)).alias("t"))
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rest = a.join(b, (a["key"] == b["other"]) & (a["s"] == b["t"]) & (F.col("ca") != F.col("cb")) & once & _near(similarity)).select("a", "b")
    edges = stars(parts).union(_alike(rest, signatures, docs, classes, k, similarity))
    discard(left), discard(signatures), discard(members)
    return _components(each, classes, edges)


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the least of their class of similar documents, with all their
    columns. Rows with a null doc_id belong to no class and stay; rows that share a doc_id stay or go
    together. Null, empty and wordless texts are alike, so one of them stays. Columns may have any
    name; no rows give no rows."""
    gone = similar_documents(docs, k, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("own"))
    return rows.join(gone, rows.own == gone._gone, "left_anti").select("row.*")
