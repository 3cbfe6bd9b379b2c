"""Queries over features, bins and classes (scalar functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.common import BINS, r6, text
from braidvec.catalog.registry import query
from braidvec.catalog.sqltext import WITH
from braidvec.catalog.sqltext import r6 as sql_r6
from braidvec.functions import features as X
from braidvec.functions import properties as P
from braidvec.operators import graphs as G
from braidvec.operators.stats import size_edge_marginals


@query("feature_index", f"{WITH} SELECT graph_id, node_id, idx FROM idx_nodes")
def _(t):
    return t.nodes.select("graph_id", "node_id", X.feature_index("feat", BINS).alias("idx"))


@query("feature_tuple", f"{WITH} SELECT graph_id, node_id, feat FROM idx_nodes")
def _(t):
    back = X.feature_tuple(X.feature_index("feat", BINS), BINS)
    return t.nodes.select("graph_id", "node_id", text(back).alias("feat"))


ATOMS = """SELECT l_orderkey AS graph_id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS symbol,
  CAST(l_quantity AS INTEGER) % 9 AS degree, CAST(l_quantity AS INTEGER) % 5 - 2 AS charge, l_linenumber % 6 AS hs, CAST(l_linestatus = 'F' AS INTEGER) AS in_ring FROM lineitem"""


def _atoms(t):
    q = F.col("l_quantity").cast("int")
    symbol = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "N").otherwise("O")
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("line"), symbol.alias("symbol"), (q % 9).alias("degree"),
        (q % 5 - 2).alias("charge"), (F.col("l_linenumber") % 6).alias("hs"), (F.col("l_linestatus") == "F").alias("in_ring"),
    )


@query(
    "encode_node_features",
    f"""WITH a AS ({ATOMS}), m AS (SELECT *, CASE symbol WHEN 'C' THEN 1 WHEN 'N' THEN 5 ELSE 6 END AS k, greatest(degree - 1, 0) AS dg FROM a)
    SELECT graph_id, line, concat_ws(',', k, dg, CASE WHEN charge >= 0 THEN charge ELSE 2 END, hs, in_ring) AS raw,
      concat_ws(',', k, least(dg, 5), CASE WHEN charge = 0 THEN 0 WHEN charge > 0 THEN 1 ELSE 2 END, least(hs, 3), in_ring) AS sign,
      concat_ws(',', k, dg, CASE charge WHEN 1 THEN 1 WHEN -1 THEN 2 ELSE 0 END, hs) AS exact FROM m""",
)
def _(t):
    atoms = X.encode_node_features(_atoms(t), charge_mode="raw").withColumnRenamed("feat", "f_raw")
    atoms = X.encode_node_features(atoms, charge_mode="sign", clamp=True).withColumnRenamed("feat", "f_sign")
    atoms = X.encode_node_features(atoms, charge_mode="exact", with_ring=False)
    return atoms.select("graph_id", "line", text("f_raw").alias("raw"), text("f_sign").alias("sign"), text("feat").alias("exact"))


_HOT = " || ".join(f"repeat('0', f{i}) || '1' || repeat('0', {b - 1} - f{i})" for i, b in enumerate(BINS))


@query("one_hot_concat", f"{WITH} SELECT graph_id, node_id, {_HOT} AS hot FROM nodes")
def _(t):
    hot = F.transform(X.one_hot_concat("feat", BINS), lambda v: v.cast("int").cast("string"))
    return t.nodes.select("graph_id", "node_id", F.array_join(hot, "").alias("hot"))


@query("one_hot_argmax", f"{WITH} SELECT graph_id, node_id, feat FROM idx_nodes")
def _(t):
    return t.nodes.select("graph_id", "node_id", text(X.one_hot_argmax(X.one_hot_concat("feat", BINS), BINS)).alias("feat"))


@query(
    "bond_class",
    """SELECT p_partkey, CASE lower(p_type) WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 WHEN 'aromatic' THEN 4 ELSE 0 END AS other,
    CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS named FROM part""",
)
def _(t):
    names = F.array(*[F.lit(n) for n in ("single", "DOUBLE", "triple", "Aromatic", "none")])
    name = F.get(names, F.col("p_size") % 5)
    return t.read("part").select("p_partkey", X.bond_class("p_type").alias("other"), X.bond_class(name).alias("named"))


_ENTRIES = "(SELECT vec_id, unnest(embedding)::FLOAT AS x, unnest(range(len(embedding)))::INTEGER AS d FROM embeddings)"


def _entries(t):
    """All components of all vectors: (vec_id, d, x)."""
    return t.read("embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))


@query("bin_uniform", f"SELECT vec_id, d, least(greatest(CAST(trunc(x * 10::FLOAT) AS INTEGER), 0), 9) AS bin FROM {_ENTRIES}")
def _(t):
    return _entries(t).select("vec_id", "d", X.bin_uniform(F.col("x"), 10).alias("bin"))


@query("bin_clipped", f"SELECT vec_id, d, least(greatest(CAST(trunc(((x - (-0.2)::FLOAT) / 0.4::FLOAT)::FLOAT * 8::FLOAT) AS INTEGER), 0), 7) AS bin FROM {_ENTRIES}")
def _(t):
    return _entries(t).select("vec_id", "d", X.bin_clipped(F.col("x"), 8, -0.2, 0.2).alias("bin"))


@query("bin_quantile", f"SELECT vec_id, d, len(list_filter([-0.1, 0.0, 0.0, 0.1], lambda b: x >= b::FLOAT))::INTEGER AS bin FROM {_ENTRIES}")
def _(t):
    return _entries(t).select("vec_id", "d", X.bin_quantile(F.col("x"), 5, [-0.1, 0.0, 0.0, 0.1]).alias("bin"))


@query(
    "filter_graphs",
    f"""{WITH}, s AS (SELECT graph_id, count(*) AS n, max(CASE WHEN f0 IN (0, 1) THEN 0 ELSE 1 END) AS banned FROM nodes GROUP BY ALL)
    SELECT graph_id, n FROM s WHERE banned = 0 AND n BETWEEN 2 AND 9 AND graph_id IN (SELECT graph_id FROM edges)""",
)
def _(t):
    return G.filter_graphs(t.nodes, t.edges, 2, 9, [0, 1], True)


@query(
    "select_vector",
    """SELECT vec_id, list_concat(embedding[1:32], embedding[33:64])::DOUBLE[] = embedding::DOUBLE[] AS both_same, round(list_sum(embedding[1:32]::DOUBLE[]), 6) + 0.0 AS node_sum,
    round(list_sum(embedding[33:64]::DOUBLE[]), 6) + 0.0 AS graph_sum FROM embeddings""",
)
def _(t):
    wide = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    parts = X.split_vector("v", [32, 32])
    cut = wide.select("vec_id", "v", parts[0].alias("a"), parts[1].alias("b"))
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x))
    return cut.select(
        "vec_id", (X.select_vector("a", "b", "both") == F.col("v")).alias("both_same"),
        total(X.select_vector("a", "b", "node")).alias("node_sum"), total(X.select_vector("a", "b", "graph")).alias("graph_sum"),
    )


@query(
    "split_vector",
    "SELECT vec_id, embedding[1] AS first_a, embedding[20] AS last_a, embedding[21] AS first_b, embedding[64] AS last_b, len(embedding[1:20]) AS len_a, len(embedding[21:64]) AS len_b FROM embeddings",
)
def _(t):
    a, b = X.split_vector("embedding", [20, 44])
    e = t.read("embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    at = F.element_at
    return e.select(
        "vec_id", at("a", 1).alias("first_a"), at("a", -1).alias("last_a"), at("b", 1).alias("first_b"), at("b", -1).alias("last_b"),
        F.size("a").cast("long").alias("len_a"), F.size("b").cast("long").alias("len_b"),
    )


@query(
    "interpolate",
    f"""SELECT a.vec_id, t.t, CAST(d.d AS BIGINT) AS d, {sql_r6('(1 - t.t) * a.embedding[d.d + 1]::DOUBLE + t.t * b.embedding[d.d + 1]::DOUBLE')} AS v
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) t(t), range(64) d(d)""",
)
def _(t):
    e = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    rows = X.interpolate(e.join(after, "vec_id"), "a", "b", [0.0, 0.25, 0.5, 1.0])
    cells = rows.select("vec_id", "t", F.posexplode("vector").alias("d", "_v"))
    return cells.select("vec_id", "t", F.col("d").cast("long").alias("d"), r6("_v").alias("v"))


_KINDS = ("C", "N", "O", "F")


@query(
    "composition_grid",
    """WITH s AS (SELECT DISTINCT p_size AS n FROM part WHERE p_size BETWEEN 3 AND 6), g AS (SELECT s.n AS total, c.c AS k1, x.x AS k2, y.y AS k3, s.n - c.c - x.x - y.y AS k4
      FROM s, range(1, 7) c(c), range(0, 7) x(x), range(0, 7) y(y))
    SELECT p.p_partkey, CAST(g.k1 AS INTEGER) AS c, CAST(g.k2 AS INTEGER) AS n, CAST(g.k3 AS INTEGER) AS o, CAST(g.k4 AS INTEGER) AS f
    FROM part p JOIN g ON p.p_size = g.total WHERE g.k4 >= 0""",
)
def _(t):
    grid = G.composition_grid(t.spark, [k.lower() for k in _KINDS], 3, 6, "c").withColumnRenamed("total", "p_size")
    return t.read("part").select("p_partkey", "p_size").join(grid, "p_size").drop("p_size")


@query(
    "composition_grid_whole",
    """WITH m AS (SELECT max(p_size) AS top FROM part), g AS (SELECT n.n AS total, c.c AS c, x.x AS n2, y.y AS o, n.n - c.c - x.x - y.y AS f
      FROM m, range(1, 1000) n(n), range(1, 1000) c(c), range(0, 1000) x(x), range(0, 1000) y(y) WHERE n.n <= m.top AND c.c <= n.n AND x.x <= n.n - c.c AND y.y <= n.n - c.c - x.x),
    s AS (SELECT total, count(*) AS vectors, CAST(sum(c * c + 2 * n2 * n2 + 3 * o * o + 5 * f * f + c * f) AS BIGINT) AS checksum FROM g GROUP BY ALL)
    SELECT p_partkey, vectors, checksum FROM part JOIN s ON p_size = total""",
)
def _(t):
    """Every size of the table; the vectors of a size are counted and summed before they meet its rows."""
    part = t.read("part").select("p_partkey", "p_size")
    grid = G.composition_grid(t.spark, [k.lower() for k in _KINDS], 1, part.agg(F.max("p_size")).first()[0], "c")
    c, n, o, f = (F.col(k.lower()).cast("long") for k in _KINDS)
    sizes = grid.groupBy(F.col("total").alias("p_size")).agg(F.count("*").alias("vectors"), F.sum(c * c + 2 * n * n + 3 * o * o + 5 * f * f + c * f).alias("checksum"))
    return part.join(sizes, "p_size").drop("p_size")


@query(
    "hill_formula",
    f"""{WITH}, c AS (SELECT graph_id, count(*) FILTER (f0 = 0) AS c, count(*) FILTER (f0 = 1) AS n, count(*) FILTER (f0 = 2) AS o FROM nodes GROUP BY ALL)
    SELECT graph_id, CASE c WHEN 0 THEN '' WHEN 1 THEN 'C' ELSE 'C' || c END || CASE n WHEN 0 THEN '' WHEN 1 THEN 'N' ELSE 'N' || n END ||
      CASE o WHEN 0 THEN '' WHEN 1 THEN 'O' ELSE 'O' || o END AS formula FROM c""",
)
def _(t):
    kind = F.col("feat")[0]
    counts = t.nodes.groupBy("graph_id").agg(*[F.count_if(kind == i).alias(s) for i, s in enumerate(("C", "N", "O"))])
    return counts.select("graph_id", X.hill_formula({s: s for s in ("O", "N", "C")}).alias("formula"))


@query("time_bin", "SELECT event_id, CAST(least(trunc(least(value / 100.0, 1.0) * 20), 19) AS INTEGER) AS bin FROM events")
def _(t):
    return t.read("events").select("event_id", X.time_bin(F.least(F.col("value") / 100.0, F.lit(1.0)), 20).alias("bin"))


_SIZE_SQL = """sizes AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL),
cls AS (SELECT b.graph_id, b.bond, count(*) AS c FROM bonds b GROUP BY ALL),
per AS (SELECT s.n, cls.bond, sum(cls.c) AS c FROM cls JOIN sizes s USING (graph_id) WHERE s.n <= 12 GROUP BY ALL
  UNION ALL SELECT s.n, 0, sum(s.n * (s.n - 1) - coalesce(e.m, 0)) FROM sizes s LEFT JOIN (SELECT graph_id, count(*) AS m FROM bonds GROUP BY ALL) e USING (graph_id) WHERE s.n <= 12 GROUP BY ALL),
tot AS (SELECT n, sum(c) AS t FROM per GROUP BY ALL), gtot AS (SELECT sum(c) AS t FROM per),
glo AS (SELECT bond, sum(c) / (SELECT t FROM gtot) AS p FROM per GROUP BY ALL),
graphs_per AS (SELECT n, count(*) AS g FROM sizes GROUP BY ALL),
marg AS (SELECT z.size, k.bond, CASE WHEN coalesce(g.g, 0) >= 50 THEN coalesce(per.c, 0) / greatest(tot.t, 1) ELSE coalesce(glo.p, 0) END AS p
  FROM range(13) z(size) CROSS JOIN range(5) k(bond) LEFT JOIN graphs_per g ON g.n = z.size LEFT JOIN per ON per.n = z.size AND per.bond = k.bond
  LEFT JOIN tot ON tot.n = z.size LEFT JOIN glo ON glo.bond = k.bond)"""


@query(
    "noise_edges",
    f"""{WITH}, {_SIZE_SQL}, pairs AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, least(a.n, 12) AS size, coalesce(x.bond, 0) AS bond
      FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id LEFT JOIN bonds x ON x.graph_id = a.graph_id AND x.src = a.node_id AND x.dst = b.node_id),
    cum AS (SELECT p.graph_id, p.src, p.dst, p.bond, k.bond AS c, sum(0.6 * (p.bond = k.bond)::INTEGER + 0.4 * k.p) OVER (PARTITION BY p.graph_id, p.src, p.dst ORDER BY k.bond) AS cp
      FROM pairs p JOIN marg k ON k.size = p.size),
    pick AS (SELECT graph_id, src, dst, CAST(coalesce(min(c) FILTER (cp > (CAST('0x' || substr(md5(concat_ws('|', '7', graph_id, src, dst)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0), 4) AS INTEGER) AS bond FROM cum GROUP BY ALL)
    SELECT graph_id, src, dst, bond FROM pick UNION ALL SELECT graph_id, dst, src, bond FROM pick""",
)
def _(t):
    table = size_edge_marginals(t.nodes, t.bonds, 12)
    probs = F.transform(F.array_sort(F.collect_list(F.struct("bond", "p"))), lambda s: s["p"])
    wide = table.groupBy("size").agg(probs.alias("probs"))
    return G.noise_edges(t.nodes, t.bonds, wide, 0.6, 7)


@query("property_vector", "SELECT p_partkey, [p_retailprice, p_size::DOUBLE, length(p_name)::DOUBLE] AS props FROM part")
def _(t):
    registry = P.PropertyRegistry()
    registry.register_property("price", lambda df: F.col("p_retailprice"))
    registry.register_property("size", lambda df: F.col("p_size"))
    registry.register_property("name_length", lambda df: F.length("p_name"))
    part = t.read("part")
    return part.select("p_partkey", registry.property_vector(part, ["price", "size", "name_length"]).alias("props"))


@query("register_property", "SELECT p_partkey, round(abs(p_retailprice - 1000.0), 6) AS v FROM part")
def _(t):
    registry = P.PropertyRegistry()
    registry.register_property("gap", lambda df: F.abs(F.col("p_retailprice") - 1000.0))
    part = t.read("part")
    return part.select("p_partkey", F.round(registry.get_property("gap")(part), 6).alias("v"))


@query("pre_transform", "SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_size > 10")
def _(t):
    hooks = P.Hooks(pre_filter=lambda df: F.col("p_size") > 10, pre_transform=lambda df: df.withColumn("p_name", F.upper("p_name")))
    return hooks.apply(t.read("part")).select("p_partkey", "p_name")
