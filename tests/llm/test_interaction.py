import re
from itertools import permutations

from pyspark.sql import functions as F

from weftwork.llm import interaction, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n long, part string, good boolean"
LABELS = "doc_id long, quality int, toxic int, part string"


def flags(rows):
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    for d, text, source in rows:
        t = text or ""
        words = WORD.findall(t)
        yield d, source or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and least.get(t, d) < d}


def expected(rows, labels):
    labels = [r for r in labels if r[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    out = {}
    judged = list(flags(rows))
    for part in {p for _, p, _ in judged}:
        own = [(d, f) for d, p, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[name]]
                early = sum(f[name] for _, f in own) - len(gone)
                left = [(d, f) for d, f in left if not f[name]]
                only = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [name, len(left), len(gone), early, only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for key, row in out.items():
            if key[0] == part and len(row) == 7:
                row.append(shapley[row[0]])
    return {k: tuple(r[1:]) for k, r in out.items()}


def run(spark, rows, labels, **more):
    docs = spark.createDataFrame([(d, t, s, 1, "x", True) for d, t, s in rows], DOCS)
    known = spark.createDataFrame([(*r, "y") for r in labels], LABELS)
    return interaction.audit(interaction.flagged(docs, known), list("ABCDE"), **more).collect()


def test_all_orders_against_brute_force(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and doc_ids, labels that clash."""
    long_text = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long_text, "a"), (2, long_text, "a"), (2, long_text, "a"), (3, long_text + " #", "b"), (4, "x " * 300, None), (5, "x " * 300, "a"), (6, None, "a"), (7, "", "b"), (8, "", ""),
        (None, long_text, "a"), (None, None, None), (9, "ABC " * 10 + long_text, "a"), (10, "Ωé word %", "b"), (11, "a\x0bb\x1cc " * 100, "a"), (12, "word " * 20_000, "b"), (1, "other", "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, 0), (3, 1, 0)]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in run(spark, rows, labels)}
    assert got == expected(rows, labels)
    assert len(got) == 3 * 600


def test_zeros_and_empty_tables(spark):
    """A part that nothing fails and one that everything fails have all their rows; no documents have none."""
    fine = " ".join(f"w{i}" for i in range(200))
    got = run(spark, [(1, fine, "a"), (2, "# A", "b")], [])
    assert len(got) == 1200 and {(r.kept, r.removed) for r in got if r.part == "a"} == {(1, 0)}
    assert all(r.kept == 0 for r in got if r.part == "b" and r.filter in "ACD")
    assert run(spark, [], []) == []


def test_whole_table_beside_parts(spark):
    rows = [(i, f"text {i % 7} {'#' if i % 3 else ''}", f"s{i % 4}") for i in range(40)]
    got = run(spark, rows, [], whole=True)
    merged = {(o, s): v[:3] for (_, o, s), v in expected([(d, t, "all") for d, t, _ in rows], []).items()}
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in got if r.part is None} == merged


def test_other_flags(spark):
    """Any flags and any number of filters; names of several letters are joined by >."""
    rows = spark.createDataFrame([("p", True, False, 3, True, False), ("p", True, True, 2, False, True), ("p", False, False, 5, False, False)], "part string, short boolean, long boolean, n long, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in interaction.audit(rows, ["short", "long"]).collect()}
    assert got == {("short>long", 1): (5, 5, 0, 3, 3, 2, 8), ("short>long", 2): (5, 0, 2, 0, 0, 0, 2), ("long>short", 1): (8, 2, 0, 0, 0, 2, 2), ("long>short", 2): (5, 3, 2, 3, 3, 0, 8)}


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.op11_filter_audit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == expected(docs, labels)
    assert got.select(F.sum("removed")).first()[0] > 0
