"""A task profile derived from star-schema tables: nodes, dependency edges and traced commands.

Nodes are regions, nations, customers, suppliers, parts and orders, in that topological order. An
index is ``kind * 2**40 + key``: it needs no global numbering and grows with no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(kind: int, key):
    return F.lit(kind * KIND) + key.cast("bigint")


def order_runs(orders: DataFrame) -> DataFrame:
    """Runs ago of each order: the dense rank of its month, 0 the newest. The months are few,
    however many the orders are, so the rank is of distinct months only."""
    from pyspark.sql import Window

    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    months = orders.select(month.alias("m")).distinct().select("m", (F.dense_rank().over(Window.orderBy(F.col("m").desc())) - 1).alias("run"))
    return orders.withColumn("m", month).join(F.broadcast(months), "m").drop("m")  # a row a month


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, kind, name, execution, built, changed (runs ago)."""

    def plain(kind: int, name: str, key: str, word: str, ext: str, execution) -> DataFrame:
        k = F.col(key).cast("bigint")
        return table(spark, sf_dir, name).select(
            index(kind, k).alias("index"), F.lit(word).alias("kind"), F.concat(F.lit(word + "/"), k.cast("string"), F.lit("." + ext)).alias("name"),
            execution.cast("double").alias("execution"), (k % 5).cast("int").alias("built"), (k % 5 + k % 2).cast("int").alias("changed"))

    orders = order_runs(table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey").cast("bigint")
    own = orders.select(
        index(5, k).alias("index"), F.lit("order").alias("kind"), F.concat(F.lit("order/"), k.cast("string"), F.lit(".o")).alias("name"),
        (F.col("o_totalprice") / 10000).alias("execution"), F.col("run").cast("int").alias("built"), (F.col("run") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).cast("int").alias("changed"))
    out = plain(0, "region", "r_regionkey", "region", "r", F.lit(0.01))
    for more in (
        plain(1, "nation", "n_nationkey", "nation", "n", F.lit(0.01)),
        plain(2, "customer", "c_custkey", "customer", "c", F.abs(F.col("c_acctbal")) / 10000),
        plain(3, "supplier", "s_suppkey", "supplier", "s", F.abs(F.col("s_acctbal")) / 10000),
        plain(4, "part", "p_partkey", "part", "p", F.col("p_retailprice") / 10000),
        own,
    ):
        out = out.unionByName(more)
    return out


def edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """src depends on dst: src, group_no (groups run one after another), dst; each pair once a group, unless
    ``distinct`` is False."""
    t = lambda name: table(spark, sf_dir, name)

    def part(df: DataFrame, src, group_no: int, dst) -> DataFrame:
        return df.select(src.alias("src"), F.lit(group_no).alias("group_no"), dst.alias("dst"))

    once = lambda df: df.distinct() if distinct else df
    c = F.col
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    out = part(t("nation"), index(1, c("n_nationkey")), 0, index(0, c("n_regionkey")))
    for more in (
        part(t("customer"), index(2, c("c_custkey")), 0, index(1, c("c_nationkey"))),
        part(t("supplier"), index(3, c("s_suppkey")), 0, index(1, c("s_nationkey"))),
        part(t("orders"), index(5, c("o_orderkey")), 0, index(2, c("o_custkey"))),
        part(lines, index(5, c("l_orderkey")), 1, index(4, c("l_partkey"))).transform(once),
        part(lines, index(5, c("l_orderkey")), 2, index(3, c("l_suppkey"))).transform(once),
    ):
        out = out.unionByName(more)
    return out


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index of a customer, command, start and stop in seconds from the start of 2024."""
    start = F.unix_timestamp("ts").cast("double") - F.lit(1704067200.0)
    return table(spark, sf_dir, "events").select(
        index(2, F.col("user_id")).alias("index"), F.col("event_type").alias("command"), "event_id", start.alias("start"), (start + F.abs("value")).alias("stop"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested table: index, name, execution, built, changed, depends array<array<bigint>>
    by group, and traces in the order of their start."""
    groups = edges(spark, sf_dir).groupBy("src", "group_no").agg(F.array_sort(F.collect_list("dst")).alias("group"))
    depends = groups.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("group_no", "group"))).alias("g")).select(F.col("src").alias("index"), F.transform("g", lambda x: x["group"]).alias("depends"))
    own = traces(spark, sf_dir).groupBy("index").agg(F.array_sort(F.collect_list(F.struct("start", "event_id", "command", "stop"))).alias("t"))
    own = own.select("index", F.transform("t", lambda x: F.struct(x["command"].alias("command"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("traces"))
    none = F.array().cast("array<array<bigint>>")
    no_trace = F.array().cast("array<struct<command:string,start:double,stop:double>>")
    joined = nodes(spark, sf_dir).join(depends, "index", "left").join(own, "index", "left")
    return joined.select("index", "kind", "name", "execution", "built", "changed", F.coalesce("depends", none).alias("depends"), F.coalesce("traces", no_trace).alias("traces"))
