from weftwork.llm import urlfilter


def verdicts(spark, urls, rules, labels=None):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = labels and spark.createDataFrame(labels, "page_id long, label string")
    return [r.verdict for r in urlfilter.judge(pages, rules, labels).orderBy("page_id").collect()]


def test_fan_out_changes_no_verdict(spark):
    for sections in (23, 24, 40):
        urls = [f"x://a.example.com/de/{i}" for i in range(6)] + [f"x://a.example.com/s{'abcdefgh'[i % 8]}x{'abcdefgh'[i // 8]}/5" for i in range(sections)]
        assert verdicts(spark, urls, {"example.com/de/": "block"}) == ["block"] * 6 + ["allow"] * sections


def test_a_branch_that_differs_stays_apart(spark):
    urls = [f"x://h.org/bad/{i}" for i in range(40)] + [f"x://h.org/sec{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}/{j}" for i in range(50) for j in range(3)]
    labels = [(i, "block") for i in range(30)] + [(40 + i, "allow") for i in range(150) if i % 3 < 2]
    assert verdicts(spark, urls, {}, labels) == ["block"] * 40 + ["allow"] * 150


def test_alike_branches_speak_for_the_others(spark):
    for n in (6, 40):
        urls = [f"x://h.org/{'abcdefghij'[i % 10]}slug{'abcdefghij'[i // 10]}" for i in range(n + 5)]
        assert verdicts(spark, urls, {}, [(i, "block") for i in range(n)]) == ["block"] * (n + 5)


def test_whole_paths_are_judged(spark):
    deep = "/".join("abcdefghijkl")
    urls = [f"x://h.org/{deep}/spam/{i}" for i in range(20)] + [f"x://h.org/{deep}/news/{i}" for i in range(20)]
    assert verdicts(spark, urls, {}, [(i, "block") for i in range(20)]) == ["block"] * 20 + ["allow"] * 20


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], urlfilter._generalise
    monkeypatch.setattr(urlfilter, "_generalise", lambda rows: rounds.append(1) or own(rows))
    urls = ["x://h.org/" + "/".join(["s"] * 300) + f"/{x}" for x in "ab"]
    assert verdicts(spark, urls, {}, [(0, "allow")]) == ["allow"] * 2 and len(rounds) <= 2


def brute(pages, rules):
    """The verdicts by plain recursion over each host's paths."""
    import math
    import re

    variable = re.compile(r"^(?:[0-9]+|[0-9][0-9a-zA-Z_-]*[0-9]|[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]+)*|[^.]{33,})(\.[A-Za-z0-9]{1,5})?$")
    rows = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule = max((r for r in rules if (lambda n, _, p: (host == n or host.endswith("." + n)) and path.startswith("/" + p))(*r.partition("/"))), key=len, default=None)
        segs = tuple("*" + (m[1] or "") if (m := variable.match(s)) else s for s in path.split("/") if s)
        rows.append((i, host, segs, rules.get(rule)))
    template = {}

    def grow(host, key, members):
        children = {}
        for segs, rest, b, a in members:
            if rest:
                children.setdefault(rest[0], []).append((segs, rest[1:], b, a))
            else:
                template[host, segs] = key
        count = {c: (sum(m[2] for m in ms), sum(m[3] for m in ms)) for c, ms in children.items()}
        nb, na = (sum(x[k] for x in count.values()) for k in (0, 1))
        labelled = sum(b + a > 0 for b, a in count.values())
        p = nb / max(1, nb + na)
        alike = {c: b + a > 0 and labelled > 1 and abs(b / (b + a) - p) <= urlfilter.DIFFERENT * math.sqrt(p * (1 - p) / (b + a)) for c, (b, a) in count.items()}
        uniform = labelled >= urlfilter.LABELLED and sum(alike.values()) >= urlfilter.PURITY * labelled
        groups = {}
        for c, ms in children.items():
            to = "*" if alike[c] or sum(count[c]) == 0 and uniform else c
            groups.setdefault(f"{key}/{to}", []).extend(ms)
        for k, ms in groups.items():
            grow(host, k, ms)

    for host in {r[1] for r in rows}:
        shapes = {}
        for _, h, segs, label in rows:
            if h == host:
                b, a = shapes.get(segs, (0, 0))
                shapes[segs] = b + (label == "block"), a + (label == "allow")
        grow(host, "", [(s, s, b, a) for s, (b, a) in shapes.items()])
    tally, hosts, total = {}, {}, [0, 0]
    for _, h, segs, label in rows:
        for t, k in ((tally, (h, template[h, segs])), (hosts, h)):
            t.setdefault(k, [0, 0])
            if label:
                t[k][label == "allow"] += 1
        if label:
            total[label == "allow"] += 1
    w, prior = urlfilter.WEIGHT, (total[0] + 1) / (sum(total) + 2)
    out = {}
    for i, h, segs, label in rows:
        b, a = tally[h, template[h, segs]]
        pure, n = (b + w * (hosts[h][0] + w * prior) / (sum(hosts[h]) + w)) / (b + a + w), b + a
        others = [x for (_, t), x in tally.items() if t == template[h, segs] and sum(x)]
        if not n and len(others) >= urlfilter.HOSTS:
            pure, n = (sum(x[0] / sum(x) for x in others) + w * prior) / (len(others) + w), sum(map(sum, others))
        out[i] = label or ("block" if n >= urlfilter.LABELLED and pure >= urlfilter.PURITY else "allow")
    return out


def test_against_plain_recursion(spark):
    from weftwork.llm.queries import RULES

    for sf, least in (("sf0.01", 1), ("sf0.1", 100)):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, RULES).collect()}
        assert {i: v for i, (_, v) in got.items()} == brute([(r.page_id, r.url) for r in pages.collect()], RULES)
        assert sum(rule is None and v == "block" for rule, v in got.values()) >= least  # the method decides
