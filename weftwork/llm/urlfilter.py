"""URL verdicts from rules and from a tree of path templates per host.

Rules decide first: the longest rule that fits a url. For the rest, the paths of each host form a
radix tree of segments. Segments that look variable (numbers, hashes, dates, long tokens) are
wildcards from the start; branches of a node whose labelled purity does not differ significantly from
that of the node's labelled branches together are merged into one wildcard, and branches that differ
stay apart, however many there are. Branches without labelled pages join the wildcard only where
enough branches are labelled and most of these are alike. A template is rejected when it has enough
labelled pages and their share of "block", smoothed towards its host's and that towards the whole
table's, reaches a threshold. A template without labelled pages on its host borrows from the same
template on other hosts: it is rejected if enough of these are labelled and the mean of their shares,
each host counting once, smoothed towards the whole table's, reaches the threshold. Everything is
counted over all pages with DataFrame aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled pages that a rejection needs (and labelled branches that speak for the others), labelled
#: hosts that speak for another, the smoothing's weight, the purity that rejects (and the share of
#: labelled branches that are alike where they speak for the others), and the z-score beyond which
#: branches differ.
LABELLED, HOSTS, WEIGHT, PURITY, DIFFERENT = 5, 3, 4.0, 0.8, 1.96
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule ``host/path`` fits: its host or a subdomain, and a path that starts alike."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def decide(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # later ones win
        rule, verdict = F.when(fits(r, host, path), r).otherwise(rule), F.when(fits(r, host, path), rules[r]).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with variable ones as wildcards that keep a file extension."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = r"^(?:[0-9]+|[0-9][0-9a-zA-Z_-]*[0-9]|[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]+)*|[^.]{33,})(\.[A-Za-z0-9]{1,5})?$"
    return F.transform(parts, lambda s: F.when(s.rlike(variable), F.concat(F.lit(WILD), F.regexp_extract(s, variable, 1))).otherwise(s))


def _shared(rows: DataFrame) -> DataFrame:
    """Moves the segments that all paths of a node share from ``rest`` to ``template``: the least and
    the greatest path share them, so does every one between."""
    node = rows.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    apart = F.array_position(F.zip_with("low", "high", lambda a, b: ~a.eqNullSafe(b)), True)
    node = node.select("host", "template", F.when(apart == 0, F.size("low")).otherwise(apart - 1).cast("int").alias("n"))
    n, gone = F.col("n"), F.slice("rest", 1, F.col("n"))
    moved = rows.join(node, ["host", "template"])
    template = F.concat("template", F.array_join(F.transform(gone, lambda s: F.concat(F.lit("/"), s)), ""))
    return moved.withColumn("template", template).withColumn("rest", F.slice("rest", n + 1, F.greatest(F.size("rest") - n, F.lit(0)))).drop("n")


def _generalise(rows: DataFrame) -> DataFrame:
    """Moves each path's next segment to its template: the literal, or a wildcard where the branch is
    merged. The number of branches does not count."""
    here = rows.withColumn("child", F.element_at("rest", 1))
    branch = here.groupBy("host", "template", "child").agg(F.sum("block").alias("cb"), F.sum("allow").alias("ca"))
    node = branch.groupBy("host", "template").agg(F.sum("cb").alias("nb"), F.sum("ca").alias("na"), F.sum(F.when(F.col("cb") + F.col("ca") > 0, 1).otherwise(0)).alias("labelled"))
    n, m = F.col("cb") + F.col("ca"), F.col("nb") + F.col("na")
    p = F.col("nb") / F.greatest(m, F.lit(1))
    spread = F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)))
    alike = (n > 0) & (F.col("labelled") > 1) & (F.abs(F.col("cb") / F.greatest(n, F.lit(1)) - p) <= DIFFERENT * spread)
    tested = branch.join(node, ["host", "template"]).withColumn("alike", alike)
    uniform = tested.groupBy("host", "template").agg(((F.max("labelled") >= LABELLED) & (F.count(F.when(F.col("alike"), 1)) >= PURITY * F.max("labelled"))).alias("uniform"))
    chosen = tested.join(uniform, ["host", "template"]).select("host", "template", "child", F.when(F.col("alike") | ((n == 0) & F.col("uniform")), WILD).otherwise(F.col("child")).alias("to"))
    moved = here.join(chosen, ["host", "template", "child"]).withColumn("template", F.concat("template", F.lit("/"), "to"))
    return moved.withColumn("rest", F.slice("rest", 2, F.size("rest"))).select(*rows.columns)


def templates(pages: DataFrame) -> DataFrame:
    """(host, segs, block, allow, template) of every distinct path shape; ``pages``: host, segs, label.
    Each round takes one branching of the tree, however many segments lie between."""
    shapes = pages.groupBy("host", "segs").agg(F.count(F.when(F.col("label") == "block", 1)).alias("block"), F.count(F.when(F.col("label") == "allow", 1)).alias("allow"))
    rows = materialize(_shared(shapes.withColumn("template", F.lit("")).withColumn("rest", F.col("segs"))), "shapes")
    done = None
    while True:
        ended = rows.where(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.unionByName(ended)
        live = rows.where(F.size("rest") > 0)
        if not live.limit(1).count():
            return done
        rows = materialize(_shared(_generalise(live)), "shapes")


def purity(rows: DataFrame) -> DataFrame:
    """(host, template, purity, labelled, hosts): the smoothed share of "block" of each template; of
    the same template on other hosts if no page of it is labelled, and then how many hosts speak."""
    total = rows.agg(F.sum("block").alias("tb"), F.sum("allow").alias("ta"))
    prior = (F.coalesce("tb", F.lit(0)) + 1) / (F.coalesce("tb", F.lit(0)) + F.coalesce("ta", F.lit(0)) + 2)
    hosts = rows.groupBy("host").agg(F.sum("block").alias("hb"), F.sum("allow").alias("ha")).join(F.broadcast(total.select(prior.alias("prior"))))  # one row
    hosts = hosts.select("host", "prior", ((F.col("hb") + WEIGHT * F.col("prior")) / (F.col("hb") + F.col("ha") + WEIGHT)).alias("host_purity"))
    each = rows.groupBy("host", "template").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"))
    n = F.col("a") + F.col("b")
    others = each.where(n > 0).groupBy("template").agg(F.sum(F.col("b") / n).alias("shares"), F.count("*").alias("hosts"), F.sum(n).alias("pages"))
    own = (F.col("b") + WEIGHT * F.col("host_purity")) / (n + WEIGHT)
    lent = (F.col("shares") + WEIGHT * F.col("prior")) / (F.col("hosts") + WEIGHT)
    found = each.join(hosts, "host").join(others, "template", "left")
    borrows = (n == 0) & (F.col("hosts") >= HOSTS)
    return found.select("host", "template", F.when(borrows, lent).otherwise(own).alias("purity"), F.when(borrows, F.col("pages")).otherwise(n).alias("labelled"))


def judge(pages: DataFrame, rules: dict[str, str], labels: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity. Whole paths are judged.

    ``rules``: rule to "allow" or "block". ``labels``: (page_id, label) with the same words for some
    pages; without it, the pages that rules decide are the labelled ones. A null url or one without
    ``://`` has an empty host and path and is allowed unless its template is rejected. page_id may
    be null or repeated: one row for each row. Extra columns are ignored; no rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = decide(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), decided.alias("decided"), segments(F.col("path")).alias("segs"))
    if labels is None:
        labelled = rows.withColumn("label", F.col("decided"))
    else:
        known = labels.where("label in ('allow', 'block')").groupBy("page_id").agg(F.max("label").alias("label"))
        labelled = rows.join(known, "page_id", "left")
    shapes = templates(labelled.select("host", "segs", "label"))
    judged = shapes.join(purity(shapes), ["host", "template"]).select("host", "segs", "template", "purity", F.when((F.col("labelled") >= LABELLED) & (F.col("purity") >= PURITY), "block").otherwise("allow").alias("method"))
    out = rows.join(judged, ["host", "segs"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", "method").alias("verdict"), "template", "purity")
