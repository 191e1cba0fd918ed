"""Decontamination, top-k, toxicity, urls, pages and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftwork.llm import bitslice, decontaminate, htmltext, queries, simhash, toxicity, urlfilter

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute_hits(docs, items, window=13):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for p, owners in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = [1] * len(p)
                    found |= owners
        out[d] = (len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def corpus():
    rnd = random.Random(8)
    vocabulary = ["The", "of", "é", "x1", *[f"w{i}" for i in range(30)]]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(1, 40))) for i in range(12)] + [(50, None), (51, "..."), (52, "of"), (53, "the the the the"), (7, "again w1 w2")]
    docs = [(0, None), (1, ""), (2, "-"), (3, "the The THE the the")]
    for d in range(4, 40):
        parts = [text(rnd.randint(0, 50))]
        if d % 2:
            w = (items[d % 12][1] or "").split()
            a = rnd.randrange(max(1, len(w) // 2))
            parts.append(", ".join(w[a:]).upper())
        docs.append((d, "\n".join([*parts, text(3)])))
    return docs, items


def test_decontamination(spark, monkeypatch):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame([*items, (None, "w1")], "item_id long, text string")
    want = brute_hits(docs, items)

    def got():
        rows = decontaminate.contamination(frame, bench).collect()
        return {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in rows}

    assert got() == want
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (100,))
    assert got() == want
    kept = {r.doc_id for r in decontaminate.remove_contaminated(frame, bench).collect()}
    assert kept == {d for d, w in want.items() if not w[3]}
    assert decontaminate.contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert decontaminate.proximity(frame, bench.where("item_id = 1")).count() > 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "QUERY_BYTES", 80)
    monkeypatch.setattr(bitslice, "ROW_BYTES", 1000)
    monkeypatch.setattr(bitslice, "AT_ONCE", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5).astype(np.float32).round(1)]) for i in range(90)]
    rows += [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [math.nan] * 5), (94, [math.inf] * 5), (10, [1.0] * 5), (None, [1.0] * 5), (95, [9.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = sorted(tuple(r) for r in bitslice.top_k(frame, frame.where("vec_id % 10 = 0"), k=4).collect())
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and math.isfinite(x) for x in v)]
    want, asked = [], set()
    for q, a in good:
        if q % 10 == 0 and q != 10:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:4]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
            asked.add(q)
    assert [g for g in got if g[0] != 10] == sorted(want)
    assert len([g for g in got if g[0] == 10]) == 4  # a repeated id is asked once
    assert bitslice.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert len(bitslice.top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0")).collect()) == 2


def test_toxicity(spark):
    rnd = random.Random(1)
    clean = ["river", "stone", "letter", "window", "garden", "yellow", "market", "paper"]
    def text(bad):
        w = [rnd.choice(clean) for _ in range(rnd.randint(5, 300))]
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["worthless", "disgusting", "pathetic"])
        return " ".join(w)
    rows = [(i, text(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "you w0rthless river", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(0, 0), (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(400)) >= 390
    assert got[900].predicted == got[901].predicted == 0 and got[902].score > got[901].score
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    import zlib
    assert held == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one).agg(F.max("score")).first()[0] < 0.01


def test_held_out_accuracy(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > 0.92
    assert sum(r.predicted for r in rows if r.toxic == 0) / len(rows) < 0.03


def test_urls(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block"}
    urls = ["HTTP://A.Example.NET/en/1?x#y", "x://net", "x://net/", "x://anet/", "x://a.net?p/", "no scheme", None, "", "x://EXAMPLE.com/de/5", "x://ü.NET/", "x://example.net/en", "x://h.org/a/1.html"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("net", "", None, "allow") and got[2] == ("net", "/", "net/", "block") and got[3][2] is None
    assert got[4] == ("a.net", "", None, "allow") and got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("example.com/de/", "block") and got[9] == ("ü.net", "/", "net/", "block") and got[10][2] == "net/"
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_templates_reject_impure_branches(spark):
    urls = [(i, f"x://h.org/spam/{i}") for i in range(40)] + [(100 + i, f"x://h.org/news/{i}/a.html") for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, "block") for i in range(20)] + [(100 + i, "allow") for i in range(20)], "page_id long, label string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, {}, labels).collect()}
    assert got == {i: "block" if i < 100 else "allow" for i, _ in urls}


def test_pages(spark):
    v = htmltext.visible_text
    assert v("<title>x</title><h1>A &amp; B</h1><p>one<p>two <b>bold</b>er") == "A & B\n\none\n\ntwo bolder"
    assert v("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>end") == "- a\n- b\n  3. x\n  4. y\n\nend"
    assert v("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>both</table>") == "Name       N\nlong name  1\nboth"
    assert v("a<div style='display: NONE'>no</div><script>if(a<b)</script><p hidden>no</p><pre>\n x\n  y</pre>") == "a\n\n x\n  y"
    assert v("a<br>b &lt;i&gt; <!-- no --> c</p>d") == "a\nb <i> c\n\nd"
    assert v(None) == v("") == v("<p>") == ""
    assert v("<div>" * 5000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "<p>x", "u", "t"), (1, "<p>x", "u", "t"), (None, None, "u", "t")], "page_id long, html string, url string, text string")
    assert sorted((str(r[0]), *r[1:]) for r in htmltext.extract(pages).collect()) == [("1", "x", 1, 1), ("1", "x", 1, 1), ("None", "", 0, 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def brute_classes(rows, k=5, similarity=0.8):
    """The least doc_ids of the components of documents with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1) if w else 0))
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x == y or both >= similarity * (len(x) + len(y) - both) - 1e-9:
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return {find(d) for d in ids}


def brute_cut(rows, window=50):
    first, out = {}, {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if first.setdefault(raw[p : p + window], d) < d:
                gone[p : p + window] = b"\1" * window
        out[d] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_top_k_does_not_depend_on_partitions(spark):
    rows = [(i, [1.0 * ((i * j) % 7) for j in range(1, 3 + i % 3)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 2 = 0")
    want = sorted(tuple(r) for r in bitslice.top_k(frame.coalesce(1), asked, k=3).collect())
    assert len(want) == 18
    for again in (frame.repartition(12), frame.repartition(4, "vec_id")):
        assert sorted(tuple(r) for r in bitslice.top_k(again, asked.repartition(3), k=3).collect()) == want
    best = lambda q: sorted((-sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(q[1], v)), i) for i, v in rows if len(v) == len(q[1]) and i != q[0])[:3]
    assert want == sorted((q[0], k + 1, i, -s) for q in rows if q[0] % 2 == 0 for k, (s, i) in enumerate(best(q)))
    with pytest.raises(Exception, match="53 bits"):
        bitslice.top_k(spark.createDataFrame([(0, [1e300]), (50, [1.0])], frame.schema), asked.limit(0).union(spark.createDataFrame([(0, [1.0])], frame.schema))).collect()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomial_hashes(spark):
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} tail")], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.matches(docs, spark.createDataFrame([(7, one), (8, other)], "item_id long, text string")).collect()}
    assert got == {1: [7], 2: [8], 3: [7]}
    from tokenizers import Tokenizer

    import public_tokenizers
    from weftwork.llm import automaton, transducer
    from weftwork.llm.common import distinct_words

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in transducer.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    fill = " ".join(f"f{i}" for i in range(19))
    passages = spark.createDataFrame([(1, f"{fill} {one}"), (2, f"{fill} {other}"), (3, f"{fill} {one}")], docs.schema)
    assert [r.n_removed for r in automaton.repeated_passages(passages).orderBy("doc_id").collect()] == [0, 0, 20]
    raw = np.frombuffer(f"{one} {other} {one}".encode(), np.uint8)
    starts = np.array([0, 4097, 8194])
    assert distinct_words(raw, starts, starts + 4096)[0].tolist() == [0, 1, 0]  # op1's training and scoring


def test_proximity_against_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string").repartition(3)
    found = decontaminate.proximity(frame, spark.createDataFrame(items, "item_id long, text string"), within=15, share=0.8)
    got = {(r.doc_id, r.item_id): r.words for r in found.collect()}
    seen = {}
    for _, t in docs:
        for w in words(t):
            seen[w] = seen.get(w, 0) + 1
    want = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            p = words(it)
            for k in range(max(1, len(p) - 12) if p else 0):
                phrase = list(dict.fromkeys(p[k : k + 13]))
                enough = math.ceil(0.8 * len(phrase) - 1e-9)
                rarest = sorted(phrase, key=lambda x: seen.get(x, 0))[: len(phrase) - enough + 1]
                for at in (x for x in range(len(w)) if w[x] in rarest):
                    n = len(set(phrase) & set(w[max(0, at - 15) : at + 16]))
                    if n >= enough:
                        want[d, i] = max(want.get((d, i), 0), n)
    assert got == want


def test_clashing_columns(spark):
    passage = " ".join(f"b{i}" for i in range(13))
    text = "awful nasty " + passage
    names = ["toxic", "h", "_id", "_spans", "n_words", "n_removed", "spans", "row", "own", "doc", "hash", "rest", "now", "was", "sub", "asked", "marks", "key", "_gone", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, f"{text} {i}", *names) for i in range(6)] + [(None, None, *names), (9, "kind", *names)], schema)
    labels = spark.createDataFrame([(0, 1), (9, 0)], "doc_id long, toxic int")
    from weftwork.llm import automaton, runlength

    for made in (toxicity.remove_toxic(docs, labels), simhash.keep_one(docs), runlength.remove_long_repeats(docs), automaton.remove_passages(docs), decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))):
        rows = made.collect()
        assert made.columns == docs.columns and rows and all(tuple(r)[2:] == tuple(names) for r in rows)
        assert any(r.doc_id == 9 and r.text == "kind" for r in rows)


def test_remove_passages(spark):
    from weftwork.llm import automaton

    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, passage, 5), (2, f"a  {passage} b", 5), (3, passage, 5), (4, "", 5), (5, None, 5), (None, passage, 5)], "doc_id long, text string, n int")
    got = {r.doc_id: r.text for r in automaton.remove_passages(docs).collect()}
    assert got == {1: passage, 2: "a b", 4: "", 5: None, None: passage}
    assert automaton.remove_passages(docs.limit(0)).count() == 0


def test_a_clean_word_in_front_changes_few_verdicts(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    plain = toxicity.score(docs, model).select("doc_id", "predicted")
    led = toxicity.score(docs.withColumn("text", F.concat(F.lit("the "), "text")), model).select("doc_id", F.col("predicted").alias("led"))
    changed = plain.join(led, "doc_id").where(toxicity.held_out(F.col("doc_id"))).agg(F.avg((F.col("predicted") != F.col("led")).cast("double"))).first()[0]
    assert changed < 0.002


def test_scores_against_plain_python(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["good", "nice", "Mild", "worthless", "w0rthless", "é"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    model = toxicity.train([t.encode() for _, t in rows], np.array([int("orth" in t) for _, t in rows]))
    own = model.vectors.astype(np.float32).astype(float) @ (model.weights[1] - model.weights[0])

    def word(w):
        raw = np.frombuffer(w, np.uint8)
        return own[toxicity.subwords(raw, np.array([0]), np.array([len(raw)]))[1]].mean()

    def score(t):
        w = [word(x) for x in words(t)]
        if not w:
            return 0.0
        worst = max(sum(w[i : i + 2]) / len(w[i : i + 2]) for i in range(max(1, len(w) - 1)))
        return 1 / (1 + math.exp(-(toxicity.WORST * worst + toxicity.AVERAGE * sum(w) / len(w) + model.bias)))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - score(t)) < 1e-4 for i, t in rows)


def test_unclosed_tags_take_linear_time():
    import time

    for broken in ("<a ", '<p x="', "<p x='\"", "<", "</b ", "<!--", "<!x ", "<p x=\"<q y='"):
        begun = time.time()
        htmltext.visible_text(broken * 60000)
        assert time.time() - begun < 5, broken
    assert htmltext.visible_text("a <b title='>'>x</b> <p class=") == "a x"


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(3000)) for _ in range(300_000))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, long), (2, long[:500_000]), (3, "short")], schema)
    from weftwork.llm import runlength

    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in runlength.long_repeats(docs).collect()}
    assert got == {1: (len(long), 0), 2: (500_000, 500_000), 3: (5, 0)}
    small = simhash.fingerprints(docs).orderBy("doc_id").collect()
    before, simhash.LONG = simhash.LONG, 1 << 30
    try:
        assert simhash.majority(simhash.shingle_hashes(long.encode(), 3)) & ((1 << 64) - 1) == small[0].fp & ((1 << 64) - 1)
    finally:
        simhash.LONG = before
    item = " ".join(long.split()[299_000:299_020])
    hits = {r.doc_id: r.hits for r in decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: [299_000, 299_020], 2: [], 3: []}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, SF)
        if k < 4:
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
            if k == 1:  # the stage's own contract: five words, a similarity of 0.8
                assert {r.doc_id for r in now.collect()} == brute_classes([(r.doc_id, r.text) for r in before.collect()])
            if k == 2:  # as the operator's own brute force cuts them
                assert {r.doc_id: r.text for r in now.collect()} == brute_cut([(r.doc_id, r.text) for r in before.collect()])
    rows = {r.doc_id: r for r in now.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert set(rows) == set(texts)
    assert all(rows[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items())
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
