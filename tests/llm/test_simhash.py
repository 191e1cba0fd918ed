import random

import numpy as np
import pytest
import xxhash

from weftwork.llm import simhash
from weftwork.llm.components import connected_components


def brute_fingerprint(text, k=3):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    rows = sorted(pairs)
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, f in rows:
            for e, g in rows:
                if bin(f ^ g).count("1") <= 2 and label[e] < label[d]:
                    label[d], changed = label[e], True
    return label


def test_code_is_perfect():
    index = simhash.golay_index()
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    for flips in ((0,), (3, 3), (22, 5), (7, 11), (1, 2)):
        other = words.copy()
        for b in set(flips):
            other = other ^ np.uint32(1 << b)
        a, b = simhash.golay_keys(words), simhash.golay_keys(other)
        for i in range(len(words)):
            assert set(a[1][a[0] == i]) & set(b[1][b[0] == i])


@pytest.mark.parametrize("bucket", [64, 2])
def test_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(5)
    vocabulary = [f"Wö{i}" for i in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a\x0bb\x0cc d"]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 900))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            if rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(1, None), (None, "x y z")]
    docs = spark.createDataFrame([(d, t, "clash", 9) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = [(d, brute_fingerprint(t)) for d, t in rows if d is not None]
    label = brute_components(want)
    assert got == {(d, f, label[d]) for d, f in want}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_keep_one_finds_all_similar_documents(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = ["", " \n", "one", "ONE", "a b c d e", "a b c d f"]
    for n in (9, 30, 60, 200, 400):
        for _ in range(4):
            base = [rnd.choice(vocabulary) for _ in range(n)]
            for edits in (0, 0, *range(1, 8)):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(n)] = rnd.choice(vocabulary)
                texts.append(" ".join(copy))
    rnd.shuffle(texts)
    label = list(range(len(texts)))
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs, 5, 0.8).collect()} == dict(enumerate(label))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(label)


def test_the_pipeline_keeps_one_of_similar_documents(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(300)]
    changed = [w if i not in (50, 150, 250) else "x" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, "other words of some text")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]


def test_simhash_brings_the_first_candidates_of_keep_one(spark, monkeypatch):
    rnd = random.Random(3)
    base = [rnd.choice([f"w{i}" for i in range(900)]) for _ in range(800)]
    near = base[:-1] + ["other"]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, "words of no other text at all")], "doc_id long, text string")
    sims = [simhash.majority(iter([np.unique(np.concatenate(list(simhash.shingle_hashes(" ".join(w).encode(), 5))))])) for w in (base, near)]
    assert bin(sims[0] ^ sims[1]).count("1") <= 2
    asked, own = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: asked.append({frozenset(r) for r in pairs.collect() if r.a != r.b}) or own(pairs, *rest))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
    assert [len(a) for a in asked] == [1, 0, 0]


def test_later_searches_of_components_start_from_stars(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.choice([f"w{i}" for i in range(900)]) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join([*base[:-1], f"end{i}"])) for i in range(8)], "doc_id long, text string")
    given, found, own = [], [], simhash.connected_components

    def watched(edges):
        given.append({(r.a, r.b) for r in edges.collect() if r.a != r.b})
        parts = own(edges)
        found.append({r.node: r.component for r in parts.collect()})
        return parts

    monkeypatch.setattr(simhash, "connected_components", watched)
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]
    assert len(given) == 3 and len(set(found[0].values())) < len(found[0]) - 1
    # What the first search put together comes back as one edge from each node to its component, not as all pairs.
    again = {(a, b) for a, b in given[1] if found[0].get(a, a) == found[0].get(b, b)}
    assert again == {(n, c) for n, c in found[0].items() if n != c} and len(given[0]) > len(again)
