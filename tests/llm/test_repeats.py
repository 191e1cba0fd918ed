"""Long byte strings and word passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from weftwork.llm import automaton, repeats, runlength


def texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = [None, "", "   ", "short", "x" * 300, "y z " * 80]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            parts += [p[a : a + rnd.randint(20, 300)], " ".join(word() for _ in range(rnd.randint(0, 10)))]
        out.append("\n".join(parts))
    return out + out[10:14] + ["same line of every document " * 3 + word() for _ in range(30)]


def brute_bytes(rows, window=50):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if first.setdefault(raw[p : p + window], i) < i:
                gone[p : p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [0] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                gone[p : p + window] = [1] * window
            seen.add(w)
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame([(i, t, "clash", 7) for i, t in rows] + [(None, "left out", "", 1)], "doc_id long, text string, blob string, start int").repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_bytes(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "SLICE_SYMBOLS", 120)
        monkeypatch.setattr(runlength, "INDEX_BYTES", 500)
        monkeypatch.setattr(repeats, "HOT", 1)
    rows, frame = docs
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runlength.long_repeats(frame).collect()}
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("hot", [256, 1])
def test_words(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows, frame = docs
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automaton.repeated_passages(frame).collect()}
    assert got == brute_words(rows)


def test_rows_that_share_an_id(spark):
    a, b = "first text that is long enough to count as a repeat, by far", "another text that is long enough to be a repeat too, by far"
    frame = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (2, b), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in runlength.long_repeats(frame).collect())
    assert got == [(1, len(a), 0), (1, len(a), 0), (1, len(b), 0), (2, 0, 0), (2, len(b), len(b)), (2, len(b), len(b))]
    assert automaton.repeated_passages(frame).count() == 6


def test_cut_texts(spark):
    shared = "a passage that two documents have, é of more than fifty bytes"
    frame = spark.createDataFrame([(1, shared, 1, "x"), (2, f"<{shared}>", 1, "y"), (3, shared, 1, "z"), (4, None, None, "w")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: tuple(r)[1:] for r in runlength.remove_long_repeats(frame).collect()}
    assert got == {1: (shared, 1, "x"), 2: ("<>", 2, "y"), 3: ("", 0, "z"), 4: (None, None, "w")}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert runlength.long_repeats(none).count() == 0 and automaton.repeated_passages(none).count() == 0


def test_index_statistics():
    rnd = random.Random(3)
    for _ in range(20):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 20))) for _ in range(rnd.randint(1, 8))]
        size = np.array([len(p) for p in pieces])
        index = runlength.RunLengthIndex(np.frombuffer(b"".join(pieces), np.uint8), size)
        query = bytes(rnd.choice(b"abc") for _ in range(15))
        got = {}
        for _, offset, length, _ in index.statistics(np.frombuffer(query, np.uint8), np.zeros(1, np.int64), np.array([15]), 99):
            got[int(offset[0])] = int(length[0])
        assert got == {i: max(n for n in range(16 - i) if any(query[i : i + n] in p for p in pieces)) for i in range(15)}


def test_automaton_statistics():
    rnd = random.Random(4)
    for _ in range(30):
        shard, pieces = automaton.SuffixAutomaton(), [[rnd.randint(0, 2) for _ in range(rnd.randint(1, 12))] for _ in range(4)]
        at = 0
        for p in pieces:
            shard.add(p, at)
            at += len(p)
        query = [rnd.randint(0, 3) for _ in range(12)]
        inside = lambda q: any(q == p[i : i + len(q)] for p in pieces for i in range(len(p) - len(q) + 1))
        for end, (length, _) in enumerate(shard.stream(query, 99), 1):
            assert length == max(n for n in range(end + 1) if inside(query[end - n : end]))
