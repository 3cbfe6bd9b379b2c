"""Queries over node and edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.common import r6, text
from braidvec.catalog.registry import query
from braidvec.catalog.sqltext import WITH, WITH_RECURSIVE
from braidvec.catalog.sqltext import r6 as sql_r6
from braidvec.functions.features import bin_walk
from braidvec.operators import graphs as G
from braidvec.operators import walks as W
from braidvec.schema import WalkConfig

STEPS = """st AS (SELECT user_id AS graph_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS src,
  lead(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
steps AS (SELECT * FROM st WHERE dst IS NOT NULL)"""


@query("symmetrize", f"WITH {STEPS} SELECT graph_id, src, dst FROM steps WHERE src <> dst UNION SELECT graph_id, dst, src FROM steps WHERE src <> dst")
def _(t):
    return G.symmetrize(t.user_steps)


@query("double_edges", f"WITH {STEPS} SELECT graph_id, src, dst FROM steps UNION ALL SELECT graph_id, dst, src FROM steps")
def _(t):
    return G.double_edges(t.user_steps)


@query(
    "check_symmetric",
    f"WITH {STEPS} SELECT DISTINCT graph_id, src, dst FROM steps a WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM steps b WHERE b.graph_id = a.graph_id AND b.src = a.dst AND b.dst = a.src)",
)
def _(t):
    return G.check_symmetric(t.user_steps)


@query("degrees", f"{WITH} SELECT graph_id, node_id, degree FROM nodes")
def _(t):
    return G.degrees(t.nodes, t.edges)


@query("residual_degree", f"{WITH} SELECT graph_id, node_id, f1 + 1 - degree AS residual FROM nodes")
def _(t):
    return G.residual_degree(t.nodes, t.edges)


@query("anchors", f"{WITH} SELECT graph_id, node_id, f1 + 1 - degree AS residual FROM nodes WHERE f1 + 1 > degree")
def _(t):
    return G.anchors(t.nodes, t.edges)


def _walk_sql(rounds: int) -> str:
    """Plain forward walks (not the halved ones), as an independent check."""
    parts = ["p0 AS (SELECT graph_id, node_id AS s, node_id AS at, 1.0::DOUBLE AS p FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"p{k} AS (SELECT w.graph_id, w.s, e.dst AS at, sum(w.p / d.degree) AS p FROM p{k - 1} w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.at "
            "JOIN deg d ON d.graph_id = w.graph_id AND d.node_id = w.at GROUP BY ALL)"
        )
    return ", ".join(parts)


def _return_sql(k: int) -> str:
    return f"""SELECT n.graph_id, n.node_id, {k} AS k, CASE WHEN n.degree = 0 THEN 1.0 ELSE coalesce(w.p, 0.0) END AS p
    FROM nodes n LEFT JOIN p{k} w ON w.graph_id = n.graph_id AND w.s = n.node_id AND w.at = n.node_id"""


_RW_SQL = f"{WITH}, {_walk_sql(6)}, rw AS ({' UNION ALL '.join(_return_sql(k) for k in (2, 3, 6))})"


@query("rw_return", f"{_RW_SQL} SELECT graph_id, node_id, k, {sql_r6('p')} AS p FROM rw")
def _(t):
    return W.rw_return(t.nodes, t.edges, (2, 3, 6)).withColumn("p", r6("p"))


_WALK = WalkConfig(ks=(2, 3, 6), num_bins=4, boundaries={2: (0.333333, 0.416667, 0.5), 6: (0.199846, 0.238426, 0.287616)})


@query(
    "augment_rw",
    f"""{_RW_SQL}, b AS (SELECT graph_id, node_id, k, CASE k
      WHEN 2 THEN (p::FLOAT >= 0.333333::FLOAT)::INTEGER + (p::FLOAT >= 0.416667::FLOAT)::INTEGER + (p::FLOAT >= 0.5::FLOAT)::INTEGER
      WHEN 6 THEN (p::FLOAT >= 0.199846::FLOAT)::INTEGER + (p::FLOAT >= 0.238426::FLOAT)::INTEGER + (p::FLOAT >= 0.287616::FLOAT)::INTEGER
      ELSE least(greatest(CAST(trunc(p::FLOAT * 4::FLOAT) AS INTEGER), 0), 3) END AS bin FROM rw)
    , w AS (SELECT graph_id, node_id, max(bin) FILTER (WHERE k = 2) AS x, max(bin) FILTER (WHERE k = 3) AS y, max(bin) FILTER (WHERE k = 6) AS z FROM b GROUP BY graph_id, node_id)
    SELECT n.graph_id, n.node_id, concat_ws(',', n.feat, w.x, w.y, w.z) AS feat FROM idx_nodes n JOIN w ON w.graph_id = n.graph_id AND w.node_id = n.node_id""",
)
def _(t):
    return W.augment_rw(t.nodes, t.edges, _WALK).select("graph_id", "node_id", text().alias("feat"))


@query("profile_nodes", f"{WITH} SELECT DISTINCT feat FROM idx_nodes")
def _(t):
    return G.profile_nodes(t.nodes).select(text().alias("feat"))


@query(
    "profile_edges",
    f"""{WITH} SELECT DISTINCT CASE WHEN a.idx <= b.idx THEN a.feat ELSE b.feat END AS fu, CASE WHEN a.idx <= b.idx THEN b.feat ELSE a.feat END AS fv
    FROM edges e JOIN idx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN idx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst""",
)
def _(t):
    return G.profile_edges(t.nodes, t.edges).select(text("fu").alias("fu"), text("fv").alias("fv"))


@query(
    "scan_rw",
    f"""{_RW_SQL}, b AS (SELECT graph_id, node_id, least(greatest(CAST(trunc(p::FLOAT * 10::FLOAT) AS INTEGER), 0), 9) AS bin FROM rw WHERE k = 6)
    SELECT DISTINCT concat_ws(',', n.feat, b.bin) AS feat FROM idx_nodes n JOIN b USING (graph_id, node_id)""",
)
def _(t):
    return W.scan_rw(t.nodes, t.edges, WalkConfig(ks=(6,), num_bins=10)).select(text().alias("feat"))


_STEP = """grow{n} AS (SELECT p.graph_id, list_append(p.path, e.dst) AS path FROM p{m} p JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.path[-1]
    WHERE e.dst > p.path[1] AND NOT list_contains(p.path, e.dst)),
  ok{n} AS (SELECT g.graph_id, g.path, EXISTS (SELECT 1 FROM edges c WHERE c.graph_id = g.graph_id AND c.src = g.path[-1] AND c.dst = g.path[1]) AS closed FROM grow{n} g
    WHERE NOT EXISTS (SELECT 1 FROM edges c WHERE c.graph_id = g.graph_id AND c.src = g.path[-1] AND list_contains(g.path[2:-3], c.dst))),
  p{n} AS (SELECT graph_id, path FROM ok{n} WHERE NOT closed)"""


RINGS_SQL = f"""p2 AS (SELECT graph_id, [src, dst] AS path FROM edges WHERE src < dst), {', '.join(_STEP.format(n=n, m=n - 1) for n in (3, 4, 5, 6))},
  found AS (SELECT * FROM ok3 UNION ALL SELECT * FROM ok4 UNION ALL SELECT * FROM ok5 UNION ALL SELECT * FROM ok6),
  rings AS MATERIALIZED (SELECT graph_id, array_to_string(path, '-') AS ring_id, CAST(len(path) AS INTEGER) AS size, unnest(path) AS node_id
    FROM found WHERE closed AND path[2] < path[-1]),
  member AS (SELECT DISTINCT graph_id, node_id, size FROM rings)"""


def ring_table(t):
    """Ring membership of the order graphs: all chordless cycles of up to six nodes."""
    return G.short_cycles(t.edges, 6).select("graph_id", "node_id", "size").distinct()


@query("ring_histogram", f"{WITH}, {RINGS_SQL} SELECT n.feat, m.size, count(*) AS cnt FROM member m JOIN idx_nodes n USING (graph_id, node_id) WHERE m.size BETWEEN 3 AND 20 GROUP BY ALL")
def _(t):
    return G.ring_histogram(t.nodes, ring_table(t)).select(text().alias("feat"), "size", "cnt")


@query(
    "single_ring_features",
    f"""{WITH}, {RINGS_SQL}, c AS (SELECT m.graph_id, m.node_id, n.feat, count(*) FILTER (m.size BETWEEN 3 AND 20) AS k FROM member m JOIN idx_nodes n USING (graph_id, node_id) GROUP BY ALL)
    SELECT feat FROM c GROUP BY feat HAVING max(k) <= 1""",
)
def _(t):
    return G.single_ring_features(t.nodes, ring_table(t)).select(text().alias("feat"))


@query("short_cycles", f"{WITH}, {RINGS_SQL} SELECT * FROM rings")
def _(t):
    return G.short_cycles(t.edges, 6)


def _lanes(c: str) -> str:
    return ", ".join(f"CAST('0x' || substr({c}, {1 + 8 * i}, 8) AS BIGINT) AS x{i}" for i in range(4))


_SUMS = ", ".join(f"sum(x{i}) AS s{i}" for i in range(4))


def wl_sql(iters: int = 3, nodes: str = "idx_nodes", edges: str = "edges") -> str:
    parts = [f"w0 AS (SELECT graph_id, node_id, label, {_lanes('label')} FROM (SELECT graph_id, node_id, md5(feat) AS label FROM {nodes}))"]
    for r in range(1, iters + 1):
        parts.append(
            f"g{r} AS (SELECT e.graph_id, e.src AS node_id, {_SUMS} FROM {edges} e JOIN w{r - 1} w ON w.graph_id = e.graph_id AND w.node_id = e.dst GROUP BY ALL), "
            f"w{r} AS (SELECT graph_id, node_id, label, {_lanes('label')} FROM (SELECT w.graph_id, w.node_id, "
            f"md5(concat_ws('|', x0, x1, x2, x3, coalesce(s0, 0), coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0))) AS label FROM w{r - 1} w LEFT JOIN g{r} g USING (graph_id, node_id)))"
        )
    parts.append(f"gs AS (SELECT graph_id, count(*) AS n, {_SUMS} FROM w{iters} GROUP BY ALL), wl AS (SELECT graph_id, n, md5(concat_ws('|', n, s0, s1, s2, s3)) AS wl FROM gs)")
    parts.append(f"gh AS (SELECT wl.graph_id, wl.wl, wl.n, CAST(coalesce(e.m, 0) // 2 AS BIGINT) AS m FROM wl LEFT JOIN (SELECT graph_id, count(*) AS m FROM {edges} GROUP BY ALL) e USING (graph_id))")
    return ", ".join(parts)


@query("wl_hash", f"{WITH}, {wl_sql()} SELECT graph_id, wl, n FROM wl")
def _(t):
    return G.wl_hash(t.nodes, t.edges)


@query("graph_hash", f"{WITH}, {wl_sql()} SELECT graph_id, wl, n, m FROM gh")
def _(t):
    return G.graph_hash(t.nodes, t.edges)


@query("dedup_graphs", f"{WITH}, {wl_sql()} SELECT wl, n, m, min(graph_id) AS graph_id, count(*) AS copies FROM gh GROUP BY ALL")
def _(t):
    return G.dedup_graphs(G.graph_hash(t.nodes, t.edges))


@query(
    "isomorphic_candidates",
    f"""{WITH}, {wl_sql()}, a AS (SELECT wl, n, m, count(*) AS n_a, min(graph_id) AS first_a FROM gh WHERE graph_id % 2 = 0 GROUP BY ALL),
    b AS (SELECT wl, n, m, count(*) AS n_b, min(graph_id) AS first_b FROM gh WHERE graph_id % 2 = 1 GROUP BY ALL)
    SELECT wl, n, m, n_a, first_a, n_b, first_b, n_a * n_b AS n_pairs FROM a JOIN b USING (wl, n, m)""",
)
def _(t):
    hashes = G.graph_hash(t.nodes, t.edges)
    return G.isomorphic_candidates(hashes.filter("graph_id % 2 = 0"), hashes.filter("graph_id % 2 = 1"))


@query(
    "isomorphic_match",
    f"""{WITH}, {wl_sql()} SELECT p.o_orderkey AS a, p.b, coalesce(x.wl = y.wl AND x.n = y.n AND x.m = y.m, false) AS candidate
    FROM (SELECT o_orderkey, o_orderkey + 1 AS b FROM orders) p LEFT JOIN gh x ON x.graph_id = p.o_orderkey LEFT JOIN gh y ON y.graph_id = p.b""",
)
def _(t):
    pairs = t.read("orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return G.isomorphic_match(pairs, G.graph_hash(t.nodes, t.edges)).select("a", "b", "candidate")


_REACH = """reach AS (SELECT graph_id, node_id, node_id AS other FROM part_nodes UNION SELECT r.graph_id, r.node_id, e.dst FROM reach r JOIN part_edges e ON e.graph_id = r.graph_id AND e.src = r.other),
comp AS (SELECT graph_id, node_id, min(other) AS label FROM reach GROUP BY ALL)"""
# Dropping the chain edges out of every third line leaves several components per graph.
_CUT_SQL = f"""{WITH_RECURSIVE}, part_nodes AS (SELECT graph_id, node_id FROM nodes), part_edges AS (SELECT graph_id, src, dst FROM edges WHERE NOT (least(src, dst) % 3 = 2 AND abs(src - dst) = 1)), {_REACH}"""


def cut_edges(t):
    return t.edges.filter(~((F.least("src", "dst") % 3 == 2) & (F.abs(F.col("src") - F.col("dst")) == 1)))


@query("components", f"{_CUT_SQL} SELECT graph_id, node_id, label FROM comp")
def _(t):
    return G.components(t.nodes, cut_edges(t))


@query("is_valid_graph", f"{_CUT_SQL} SELECT graph_id, count(DISTINCT label) AS n_components, CAST(0 AS BIGINT) AS n_loops, count(DISTINCT label) = 1 AS valid FROM comp GROUP BY ALL")
def _(t):
    return G.is_valid_graph(t.nodes, cut_edges(t))


@query(
    "cyclomatic",
    f"""{_CUT_SQL}, c AS (SELECT graph_id, count(*) AS n, count(DISTINCT label) AS c FROM comp GROUP BY ALL), m AS (SELECT graph_id, count(*) // 2 AS m FROM part_edges GROUP BY ALL)
    SELECT graph_id, n, c, coalesce(m, 0) AS m, coalesce(m, 0) - n + c AS rings FROM c LEFT JOIN m USING (graph_id)""",
)
def _(t):
    return G.cyclomatic(t.nodes, cut_edges(t))


@query("feature_counts", f"{WITH} SELECT graph_id, feat, count(*) AS cnt FROM idx_nodes GROUP BY ALL")
def _(t):
    return G.feature_counts(t.nodes).withColumn("feat", text())


_MINUS = f"""{WITH}, full_c AS (SELECT graph_id, idx, feat, f1, count(*) AS cnt FROM idx_nodes GROUP BY ALL), part_c AS (SELECT graph_id, idx, count(*) AS cnt FROM idx_nodes WHERE node_id < 2 GROUP BY ALL),
left_c AS (SELECT f.graph_id, f.idx, f.feat, f.f1, f.cnt - coalesce(p.cnt, 0) AS cnt FROM full_c f LEFT JOIN part_c p USING (graph_id, idx) WHERE f.cnt > coalesce(p.cnt, 0))"""


def _leftovers(t):
    return G.multiset_minus(G.feature_counts(t.nodes), G.feature_counts(t.nodes.filter("node_id < 2")))


@query("multiset_minus", f"{_MINUS} SELECT graph_id, feat, cnt FROM left_c")
def _(t):
    return _leftovers(t).withColumn("feat", text())


@query("order_leftovers", f"{_MINUS} SELECT graph_id, feat, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY f1, idx) AS INTEGER) AS rank FROM left_c")
def _(t):
    return G.order_leftovers(_leftovers(t)).withColumn("feat", text())


@query(
    "contains_multiset",
    f"""{WITH}, c AS (SELECT graph_id, feat, count(*) AS cnt FROM idx_nodes GROUP BY ALL), p AS (SELECT graph_id AS pattern_id, graph_id + 1 AS target_id, feat, count(*) AS cnt FROM idx_nodes WHERE node_id < 2 GROUP BY ALL)
    SELECT pattern_id, target_id, bool_and(coalesce(c.cnt, 0) >= p.cnt) AS contained FROM p LEFT JOIN c ON c.graph_id = p.target_id AND c.feat = p.feat GROUP BY ALL""",
)
def _(t):
    first = G.feature_counts(t.nodes.filter("node_id < 2"))
    patterns = first.select(F.col("graph_id").alias("pattern_id"), (F.col("graph_id") + 1).alias("target_id"), "feat", "cnt")
    return G.contains_multiset(patterns, G.feature_counts(t.nodes))


@query("edges_from_degrees", f"{WITH} SELECT graph_id, CAST(sum(f1 + 1) // 2 AS BIGINT) AS n_edges FROM nodes GROUP BY ALL")
def _(t):
    return G.edges_from_degrees(G.feature_counts(t.nodes))


@query(
    "valence_deficit",
    f"""{WITH}, u AS (SELECT graph_id, src AS node_id, sum(CASE bond WHEN 4 THEN 1.5 ELSE bond END)::DOUBLE AS used FROM bonds GROUP BY ALL)
    SELECT n.graph_id, n.node_id, (CASE f0 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END - CASE f2 WHEN 1 THEN 1 ELSE 0 END - f3 - coalesce(used, 0))::DOUBLE AS deficit,
      (CASE f0 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END - CASE f2 WHEN 1 THEN 1 ELSE 0 END - f3 - coalesce(used, 0)) < 0 AS over
    FROM nodes n LEFT JOIN u USING (graph_id, node_id)""",
)
def _(t):
    valences = t.spark.createDataFrame([(0, 4), (1, 3), (2, 2)], "kind int, valence int")
    return G.valence_deficit(t.nodes, t.bonds, valences)


def _pagerank_sql(rounds: int = 20, d: float = 0.85) -> str:
    parts = ["r0 AS (SELECT graph_id, node_id, n, degree, 1.0::DOUBLE / n AS r FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"m{k} AS (SELECT e.graph_id, e.dst AS node_id, sum(p.r / p.degree) AS got FROM edges e JOIN r{k - 1} p ON p.graph_id = e.graph_id AND p.node_id = e.src GROUP BY ALL), "
            f"z{k} AS (SELECT graph_id, sum(r) AS loose FROM r{k - 1} WHERE degree = 0 GROUP BY ALL), "
            f"r{k} AS MATERIALIZED (SELECT p.graph_id, p.node_id, p.n, p.degree, {1 - d} / p.n + {d} * (coalesce(m.got, 0) + coalesce(z.loose, 0) / p.n) AS r "
            f"FROM r{k - 1} p LEFT JOIN m{k} m USING (graph_id, node_id) LEFT JOIN z{k} z USING (graph_id))"
        )
    return ", ".join(parts)


@query("pagerank", f"{WITH}, {_pagerank_sql()} SELECT graph_id, node_id, {sql_r6('r')} AS pagerank FROM r20")
def _(t):
    return G.pagerank(t.nodes, t.edges).withColumn("pagerank", r6("pagerank"))


@query("degree_centrality", f"{WITH} SELECT graph_id, node_id, CASE WHEN n <= 1 THEN 1.0 ELSE {sql_r6('degree / greatest(n - 1, 1)')} END::DOUBLE AS centrality FROM nodes")
def _(t):
    return G.degree_centrality(t.nodes, t.edges).withColumn("centrality", r6("centrality"))


@query("all_pairs", f"{WITH} SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, 0 AS bond FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id")
def _(t):
    return G.all_pairs(t.nodes)


@query("edges_from_classes", f"{WITH} SELECT graph_id, src, dst, bond FROM bonds")
def _(t):
    known = t.bonds.withColumnRenamed("bond", "_b")
    pairs = G.all_pairs(t.nodes).join(known, ["graph_id", "src", "dst"], "left").withColumn("bond", F.coalesce("_b", "bond")).drop("_b")
    return G.edges_from_classes(pairs)


_PROFILE_BOUNDS = {2: (0.3, 0.5), 3: (0.0, 0.0), 6: (0.2, 0.25)}


def _share(k: int, b: tuple, i: int) -> str:
    edges = [0.0, *b, 1.0]
    lo, hi = edges[i], edges[i + 1]
    if i == len(edges) - 2:
        return f"WHEN {k} THEN (p >= {lo})::INTEGER"
    return f"WHEN {k} THEN (p >= {lo} AND p < {hi})::INTEGER" if lo < hi else f"WHEN {k} THEN (p = {lo})::INTEGER"


_SHARES = ", ".join(
    f"round(avg(CASE k {' '.join(_share(k, b, i) for k, b in _PROFILE_BOUNDS.items())} END), 6) AS bin{i}" for i in range(3)
)


@query(
    "rw_profile",
    f"""{_RW_SQL}, f AS (SELECT graph_id, k, round(p, 9) AS p FROM rw), s AS (SELECT graph_id, CASE WHEN count(*) > 12 THEN 'large' ELSE 'small' END AS grp FROM f GROUP BY ALL)
    SELECT grp, k, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max, {_SHARES} FROM f JOIN s USING (graph_id) GROUP BY ALL""",
)
def _(t):
    probs = W.rw_return(t.nodes, t.edges, (2, 3, 6)).withColumn("p", F.round("p", 9))
    groups = t.nodes.groupBy("graph_id").agg(F.when(F.count("*") > 4, "large").otherwise("small").alias("grp"))
    out = W.rw_profile(probs.join(groups, "graph_id"), _PROFILE_BOUNDS, "grp")
    return out.select("grp", "k", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("grp", "k")])


@query(
    "fit_quantile_bounds",
    f"""{_RW_SQL}, q AS (SELECT k, quantile_cont(round(p, 9), [0.25, 0.5, 0.75]) AS b FROM rw GROUP BY k)
    SELECT k, round(b[1], 6) AS b1, round(b[2], 6) AS b2, round(b[3], 6) AS b3 FROM q""",
)
def _(t):
    probs = W.rw_return(t.nodes, t.edges, (2, 3, 6)).withColumn("p", F.round("p", 9))
    bounds = W.fit_quantile_bounds(probs, 4)
    return bounds.select("k", *[F.col("bounds")[i].alias(f"b{i + 1}") for i in range(3)])


@query("preset_bounds", f"""{_RW_SQL}, q AS (SELECT quantile_cont(round(p, 9), [0.25, 0.5, 0.75]) AS b FROM rw WHERE k = 6)
    SELECT graph_id, node_id, (p::FLOAT >= round(b[1], 6)::FLOAT)::INTEGER + (p::FLOAT >= round(b[2], 6)::FLOAT)::INTEGER + (p::FLOAT >= round(b[3], 6)::FLOAT)::INTEGER AS bin FROM rw, q WHERE k = 6""")
def _(t):
    probs = W.rw_return(t.nodes, t.edges, (6,)).withColumn("p", F.round("p", 9))
    presets = W.fit_presets(probs, (3, 4))
    walk = WalkConfig(ks=(6,), num_bins=4, boundaries=W.preset_bounds(presets, 4))
    return W.rw_return(t.nodes, t.edges, (6,)).select("graph_id", "node_id", bin_walk("p", 6, walk).alias("bin"))
