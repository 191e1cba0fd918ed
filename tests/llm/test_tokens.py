"""Codec and token counts against the tokenizer's own library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftwork.llm import bpe, transducer
from weftwork.llm.vocabulary import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'", "'re", "'ll", "'v", "'r", "'l", "a", "B", " ", "  ", "\n", "\t", " ", "\u0085", "1", "٣", "é", "ß", "漢", "😀", "<|endoftext|>", "<|", "endoftext|>", "aaaa", "!!!!", "=", "\x1c", "e\u0301", "𝒳", "the", "ing", "'S", "hello"]


def texts():
    rnd = random.Random(6)
    return ["", " ", "'r", "x'l", *["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 30))) for _ in range(600)], "=" * 5000, "word " * 3000, "ab" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


def test_round_trip(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "LONG_CHARS", 2000)
    codec = bpe.Codec(vocabulary)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_counts(library, vocabulary, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT_STATES", 500)
    raw = [t.encode() for t in texts()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    got = transducer.TextCounter(vocabulary).counts(np.frombuffer(b"".join(raw), np.uint8), at)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_tables(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:60])] + [(None, None, 2), (3, "again", 2), (3, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs, PATH).collect()) == sorted(want)
    counts = sorted((str(r.doc_id), r.n_tokens, r.over_limit) for r in transducer.token_counts(docs, PATH, 10).collect())
    assert counts == sorted((d, n, n > 10) for d, n, *_ in want)
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs.where("doc_id < 3"), PATH), PATH).collect()}
    assert back == {i: t for i, t in enumerate(texts()[:3])}
    none = docs.limit(0)
    assert bpe.digests(none, PATH).count() == 0 and transducer.token_counts(none, PATH).count() == 0


def test_scan_of_chunks():
    after, _ = transducer.compile_words()
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, transducer.CLASSES, 1000).astype(np.uint16)
    state, want = transducer.START, []
    for s in symbols.tolist():
        want.append(state)
        state = int(after[state, s])
    assert transducer.run_chunks(after, symbols).tolist() == want


def test_each_place_of_a_word_is_looked_up_once_and_words_are_not_hashed(vocabulary, library, monkeypatch):
    looked = []

    class Counted(dict):
        def get(self, key):
            looked.append(key)
            return super().get(key)

    counter = transducer.TextCounter(vocabulary)
    counter.words.ends, counter.words.ids = Counted(counter.words.ends), None
    monkeypatch.setattr(np, "union1d", None)
    rows = [t for t in texts() if len(t) < 1000]
    raw, at = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in rows)])
    assert counter.counts(raw, at).tolist() == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    assert len(looked) > 100
