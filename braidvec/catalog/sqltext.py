"""SQL fragments for the order graphs and the hash-based codebook, shared by the oracle texts."""

from __future__ import annotations

LINE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"

GRAPHS = f"""
base AS MATERIALIZED (SELECT l_orderkey AS graph_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS INTEGER) AS node_id,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n, l_quantity AS q, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
und AS MATERIALIZED (SELECT graph_id, node_id AS a, node_id + 1 AS b FROM base WHERE node_id + 1 < n
  UNION SELECT graph_id, node_id, node_id + 2 FROM base WHERE q > 40 AND node_id + 2 < n
  UNION SELECT graph_id, 0, n - 1 FROM base WHERE node_id = 0 AND n >= 3 AND graph_id % 2 = 0),
edges AS MATERIALIZED (SELECT graph_id, a AS src, b AS dst FROM und UNION ALL SELECT graph_id, b, a FROM und),
deg AS MATERIALIZED (SELECT graph_id, src AS node_id, count(*) AS degree FROM edges GROUP BY ALL),
nodes AS MATERIALIZED (SELECT base.graph_id, base.node_id, base.n, coalesce(degree, 0) AS degree,
  CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f0, CAST(greatest(coalesce(degree, 0) - 1, 0) AS INTEGER) AS f1,
  CASE ls WHEN 'F' THEN 0 ELSE 1 END AS f2, CAST(least(floor((q - 1) / 10), 4) AS INTEGER) AS f3
  FROM base LEFT JOIN deg ON base.graph_id = deg.graph_id AND base.node_id = deg.node_id),
idx_nodes AS MATERIALIZED (SELECT *, CAST(((f0 * 6 + f1) * 2 + f2) * 5 + f3 AS BIGINT) AS idx,
  concat_ws(',', f0, f1, f2, f3) AS feat FROM nodes),
bonds AS MATERIALIZED (SELECT *, CAST(1 + (src + dst) % 4 AS INTEGER) AS bond FROM edges)"""

WITH = f"WITH {GRAPHS}"
WITH_RECURSIVE = f"WITH RECURSIVE {GRAPHS}"


def hex13(text: str, start: int = 1) -> str:
    return f"CAST('0x' || substr({text}, {start}, 13) AS BIGINT)"


def uniform(text: str, start: int = 1) -> str:
    return f"(({hex13(text, start)} + 0.5) / 4503599627370496.0)"


def map_codebook(name: str, rows: int, dim: int, seed: int) -> str:
    """Long form (idx, d, v) of a MAP codebook."""
    return f"""{name} AS (SELECT i.idx, d.d, CASE WHEN substr(md5(concat_ws('|', '{seed}', i.idx, d.d)), 1, 1) < '8' THEN 1 ELSE -1 END AS v
  FROM range({rows}) i(idx), range({dim}) d(d))"""


def hrr_codebook(name: str, rows: int, dim: int, seed: int) -> str:
    """Long form (idx, d, v) of a real HRR codebook."""
    digest = f"md5(concat_ws('|', '{seed}', i.idx, d.d))"
    return f"""{name} AS (SELECT i.idx, d.d, sqrt(-2.0 * ln({uniform(digest, 1)})) * cos(2 * pi() * {uniform(digest, 14)}) / sqrt({dim}) AS v
  FROM range({rows}) i(idx), range({dim}) d(d))"""


def fhrr_codebook(name: str, rows: int, dim: int, seed: int) -> str:
    """Long form (idx, d, re, im) of an FHRR codebook."""
    digest = f"md5(concat_ws('|', '{seed}', i.idx, d.d))"
    return f"""{name} AS (SELECT i.idx, d.d, cos(2 * pi() * {uniform(digest)}) AS re, sin(2 * pi() * {uniform(digest)}) AS im
  FROM range({rows}) i(idx), range({dim}) d(d))"""


def r6(expr: str) -> str:
    """Round to six places without a negative zero."""
    return f"round({expr}, 6) + 0.0"
