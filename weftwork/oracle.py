"""DuckDB SQL for the derived profile and the queries over it."""

from __future__ import annotations

K = 1 << 40

NODES = f"""
months AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
ranks AS (SELECT m, dense_rank() OVER (ORDER BY m DESC) - 1 AS run FROM months),
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS "index", 'region' AS kind, 'region/' || r_regionkey || '.r' AS name, CAST(0.01 AS DOUBLE) AS execution,
         CAST(r_regionkey % 5 AS INTEGER) AS built, CAST(r_regionkey % 5 + r_regionkey % 2 AS INTEGER) AS changed FROM region
  UNION ALL SELECT {1 * K} + n_nationkey, 'nation', 'nation/' || n_nationkey || '.n', CAST(0.01 AS DOUBLE), CAST(n_nationkey % 5 AS INTEGER), CAST(n_nationkey % 5 + n_nationkey % 2 AS INTEGER) FROM nation
  UNION ALL SELECT {2 * K} + c_custkey, 'customer', 'customer/' || c_custkey || '.c', abs(c_acctbal) / 10000, CAST(c_custkey % 5 AS INTEGER), CAST(c_custkey % 5 + c_custkey % 2 AS INTEGER) FROM customer
  UNION ALL SELECT {3 * K} + s_suppkey, 'supplier', 'supplier/' || s_suppkey || '.s', abs(s_acctbal) / 10000, CAST(s_suppkey % 5 AS INTEGER), CAST(s_suppkey % 5 + s_suppkey % 2 AS INTEGER) FROM supplier
  UNION ALL SELECT {4 * K} + p_partkey, 'part', 'part/' || p_partkey || '.p', p_retailprice / 10000, CAST(p_partkey % 5 AS INTEGER), CAST(p_partkey % 5 + p_partkey % 2 AS INTEGER) FROM part
  UNION ALL SELECT {5 * K} + o_orderkey, 'order', 'order/' || o_orderkey || '.o', o_totalprice / 10000, CAST(run AS INTEGER), CAST(run + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS INTEGER)
  FROM orders JOIN ranks ON m = year(o_orderdate) * 12 + month(o_orderdate))"""

EDGES = f"""
edges AS (
  SELECT {1 * K} + n_nationkey AS src, 0 AS group_no, CAST(n_regionkey AS BIGINT) AS dst FROM nation
  UNION ALL SELECT {2 * K} + c_custkey, 0, {1 * K} + c_nationkey FROM customer
  UNION ALL SELECT {3 * K} + s_suppkey, 0, {1 * K} + s_nationkey FROM supplier
  UNION ALL SELECT {5 * K} + o_orderkey, 0, {2 * K} + o_custkey FROM orders
  UNION ALL (SELECT DISTINCT {5 * K} + l_orderkey, 1, {4 * K} + l_partkey FROM lineitem)
  UNION ALL (SELECT DISTINCT {5 * K} + l_orderkey, 2, {3 * K} + l_suppkey FROM lineitem))"""

TRACES = f"""
traces AS (
  SELECT {2 * K} + user_id AS "index", event_type AS command, event_id, CAST(floor(epoch(ts)) AS DOUBLE) - 1704067200.0 AS start,
         CAST(floor(epoch(ts)) AS DOUBLE) - 1704067200.0 + abs(value) AS stop FROM events)"""

LEVELS = """
levels AS (SELECT "index", CASE kind WHEN 'region' THEN 0 WHEN 'part' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2 ELSE 3 END AS level FROM nodes)"""


def sql(body: str, *parts: str) -> str:
    return f"WITH {','.join(parts)} {body}" if parts else body


ALL = (NODES, EDGES, TRACES)
HAS_DEPS = 'EXISTS (SELECT 1 FROM edges e WHERE e.src = n."index")'
FIRST = "(SELECT command FROM traces t WHERE t.\"index\" = n.\"index\" AND command LIKE 'c%' ORDER BY start, event_id LIMIT 1)"
