"""Queries that decode vectors and rank candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.algebra import book
from braidvec.catalog.common import BINS, ROWS, r6, r6_scaled, text
from braidvec.catalog.encoding import MAP_PLAIN, map_layers
from braidvec.catalog.registry import query
from braidvec.catalog.relations import wl_sql
from braidvec.catalog.sqltext import WITH, map_codebook, r6 as sql_r6
from braidvec.functions.features import feature_tuple
from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.operators import metrics as M
from braidvec.operators.codebook import make_codebook
from braidvec.operators.decode_graph import DecodeSettings, decode_graph_of
from braidvec.schema import EncoderConfig
from braidvec.session import parts_for

WIDE = 256


def _gram(dim: int, seed: int = 42) -> str:
    """Inner products of the codebook rows that occur with all rows."""
    return f"""{map_codebook('cb', ROWS, dim, seed)}, used AS (SELECT DISTINCT idx FROM idx_nodes), ucb AS (SELECT cb.* FROM cb JOIN used USING (idx)),
    gram AS (SELECT a.idx AS i, b.idx AS j, sum(a.v * b.v) AS g FROM ucb a JOIN cb b USING (d) GROUP BY ALL),
    cnts AS (SELECT graph_id, idx, count(*) AS cnt FROM idx_nodes GROUP BY ALL),
    dots AS (SELECT c.graph_id, gram.j AS idx, sum(c.cnt * gram.g) AS dot FROM cnts c JOIN gram ON gram.i = c.idx GROUP BY ALL)"""


_DECODED = f"{WITH}, {_gram(WIDE)}, dec AS (SELECT graph_id, idx, CAST(round_even(dot / {WIDE}.0, 0) AS BIGINT) AS cnt FROM dots WHERE round_even(dot / {WIDE}.0, 0) > 0)"
_COMPARED = f"""{_DECODED}, both_c AS (SELECT coalesce(d.graph_id, c.graph_id) AS graph_id, coalesce(d.cnt, 0) AS x, coalesce(c.cnt, 0) AS y FROM dec d FULL JOIN cnts c ON c.graph_id = d.graph_id AND c.idx = d.idx)"""


def decoded(t, dim: int = WIDE):
    """Order-0 vectors of all graphs and the counts decoded from them."""
    return D.decode_counts_of_nodes(t.nodes, make_codebook(t.spark, BINS, dim, "MAP", 42), parts_for(t.nodes))


def truth(t):
    return E.with_index(t.nodes, BINS).groupBy("graph_id", "idx").agg(F.count("*").alias("cnt"))


@query("decode_counts", f"{_DECODED} SELECT graph_id, idx, cnt FROM dec")
def _(t):
    return decoded(t)


@query(
    "compare_counts",
    f"{_COMPARED} SELECT graph_id, sum(abs(x - y)) = 0 AS exact_match, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS missing, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS extra, CAST(sum(x) AS BIGINT) AS decoded_total, CAST(sum(y) AS BIGINT) AS truth_total FROM both_c GROUP BY ALL",
)
def compare(t):
    each = E.with_index(t.nodes, BINS).select("graph_id", "idx", F.lit(1).cast("long").alias("cnt"))
    return M.compare_counts(decoded(t), each, parts=parts_for(t.nodes))


@query(
    "decode_accuracy",
    f"{_COMPARED}, m AS (SELECT graph_id, sum(abs(x - y)) = 0 AS ok FROM both_c GROUP BY ALL) SELECT count(*) AS graphs, count(*) FILTER (ok) AS exact, round(avg(ok::INTEGER), 6) AS rate FROM m",
)
def decode_accuracy(t):
    """Flagship: encode all graphs, decode their node counts, and report how many come back exactly."""
    c = compare(t)
    return c.agg(F.count("*").alias("graphs"), F.count_if("exact_match").alias("exact"), F.round(F.avg(F.col("exact_match").cast("int")), 6).alias("rate"))


_EDGE_COUNTS = f"{WITH}, pe AS (SELECT e.graph_id, a.idx AS a, b.idx AS b, a.f1 + 1 AS dg, count(*) AS cnt FROM edges e JOIN idx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN idx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst GROUP BY ALL), stubs AS (SELECT graph_id, a AS idx, dg, sum(cnt) AS s FROM pe GROUP BY ALL)"

# The counts that went into the vectors are the expected result: peeling recovers nearly all, a fit of whole counts the others.
_TRUE_EDGES = f"{_EDGE_COUNTS} SELECT graph_id, a, b, CAST(cnt AS BIGINT) AS cnt FROM pe"


@query("decode_nodes_iterative", f"{WITH} SELECT graph_id, idx, count(*) AS cnt FROM idx_nodes GROUP BY ALL")
def _(t):
    cb = book(t, "MAP", WIDE)
    return D.decode_nodes_iterative_of(t.nodes, cb, parts=parts_for(t.nodes))


@query("decode_nodes_iterative_debug")
def _(t):
    cb = book(t, "HRR", WIDE)
    out = D.decode_nodes_iterative_of(t.nodes, cb, debug=True, parts=parts_for(t.nodes))
    return out.select("graph_id", F.size("picks").alias("n"), r6(F.element_at("norms", -1)).alias("last_norm"), r6(F.get("sims", F.lit(0))).alias("first_sim"))


@query("decode_edges", _TRUE_EDGES)
def _(t):
    cb = book(t, "HRR", WIDE)
    return D.decode_edges_of(t.nodes, t.edges, truth(t), cb)


@query("decode_edges_free", _TRUE_EDGES)
def _(t):
    cb = book(t, "HRR", WIDE)
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    return D.decode_edges_free_of(t.nodes, t.edges, cb, pairs=pairs, parts=parts_for(t.nodes))


def _pairs(t):
    return E.edge_pair_counts(t.nodes, t.edges, BINS)


@query("node_counts_from_edges", f"{_EDGE_COUNTS} SELECT graph_id, idx, CAST(s // dg AS BIGINT) AS cnt FROM stubs")
def _(t):
    return D.node_counts_from_edges(_pairs(t), BINS)


@query("node_counts_from_edges_ceil", f"{_EDGE_COUNTS} SELECT graph_id, idx, CAST(ceil(s / dg) AS BIGINT) AS cnt FROM stubs WHERE idx % 2 = 0")
def _(t):
    return D.node_counts_from_edges(_pairs(t).filter("a % 2 = 0"), BINS, "ceil")


@query("node_counts_from_edges_ceil_whole", f"{_EDGE_COUNTS} SELECT graph_id, idx, CAST(ceil(s / dg) AS BIGINT) AS cnt FROM stubs")
def _(t):
    return D.node_counts_from_edges(_pairs(t), BINS, "ceil")


_BROKEN = _EDGE_COUNTS.replace("stubs AS (SELECT graph_id, a AS idx, dg, sum(cnt) AS s FROM pe GROUP BY ALL)", "stubs AS (SELECT graph_id, a AS idx, dg, sum(cnt) AS s FROM pe WHERE (a + b + graph_id) % 5 <> 0 GROUP BY ALL)")


@query(
    "target_reached",
    f"{_BROKEN}, r AS (SELECT graph_id, sum(s) = sum((s // dg) * dg) AS reached FROM stubs GROUP BY ALL) SELECT g.graph_id, coalesce(r.reached, false) AS reached FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN r USING (graph_id)",
)
def _(t):
    return D.target_reached(_pairs(t).filter("(a + b + graph_id) % 5 <> 0"), BINS, t.nodes)


@query("degree_gap", f"{_BROKEN} SELECT graph_id, idx, CAST(round_even((s / dg - floor(s / dg)) * dg, 0) AS BIGINT) AS extra, CAST(round_even((ceil(s / dg) - s / dg) * dg, 0) AS BIGINT) AS missing FROM stubs")
def _(t):
    stubs = _pairs(t).filter("(a + b + graph_id) % 5 <> 0").groupBy("graph_id", F.col("a").alias("idx")).agg(F.sum("cnt").alias("s"))
    degree = feature_tuple("idx", BINS)[1] + 1
    gap = stubs.select("graph_id", "idx", D.degree_gap(F.col("s") / degree, 1 / degree).alias("g"))
    return gap.select("graph_id", "idx", "g.extra", "g.missing")


@query(
    "pairing_possible",
    f"""{_EDGE_COUNTS}, vp AS (SELECT DISTINCT a, b FROM pe WHERE graph_id % 3 = 0 UNION SELECT DISTINCT b, a FROM pe WHERE graph_id % 3 = 0),
    av AS (SELECT x.graph_id, x.idx, sum(CASE WHEN x.idx = y.idx THEN y.s - 1 ELSE y.s END) AS have FROM stubs x JOIN vp ON vp.a = x.idx JOIN stubs y ON y.graph_id = x.graph_id AND y.idx = vp.b GROUP BY ALL)
    SELECT s.graph_id, bool_and(coalesce(av.have, 0) >= s.s) AS possible FROM stubs s LEFT JOIN av USING (graph_id, idx) GROUP BY ALL""",
)
def _(t):
    pairs = _pairs(t)
    stubs = pairs.groupBy("graph_id", F.col("a").alias("idx")).agg(F.sum("cnt").alias("cnt"))
    return D.pairing_possible(stubs, pairs.filter("graph_id % 3 = 0").select("a", "b").distinct())


@query(
    "halve_edges",
    f"""{WITH}, o AS (SELECT e.graph_id, least(a.idx, b.idx) AS a, greatest(a.idx, b.idx) AS b FROM edges e JOIN idx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN idx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst),
    k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY a, b) AS rn FROM o) SELECT graph_id, a, b, count(*) AS cnt FROM k WHERE rn % 2 = 1 GROUP BY ALL""",
)
def _(t):
    return D.halve_edges(_pairs(t))


@query("sample_matchings")
def _(t):
    nodes, edges = D.sample_matchings(_pairs(t), BINS, 4, 11)
    sizes = nodes.groupBy("query_id", "graph_id").agg(F.count("*").alias("n"))
    return sizes.join(edges.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id")


_CB = map_codebook("cb", ROWS, 8, 42)
_SCORED = f"""{WITH}, {_CB}, {wl_sql()}, {map_layers(2, False)}, emb AS (SELECT graph_id, d, sum(v) AS v FROM alls GROUP BY ALL),
  uq AS (SELECT min(graph_id) AS graph_id, graph_id // 4 AS query_id FROM gh GROUP BY graph_id // 4, wl, n, m),
  sims AS (SELECT u.query_id, u.graph_id AS cand_id, sum(e.v * q.v) / greatest(sqrt(sum(e.v * e.v)), 1e-8) / greatest(sqrt(sum(q.v * q.v)), 1e-8) AS sim FROM uq u JOIN emb e USING (graph_id) JOIN emb q ON q.graph_id = u.query_id * 4 AND q.d = e.d GROUP BY ALL)"""


def _grouped(t):
    owner = F.floor(F.col("graph_id") / 4).cast("long").alias("query_id")
    return t.nodes.withColumn("query_id", owner), t.edges.withColumn("query_id", owner)


def _query_vectors(t):
    own = E.encode(t.nodes.filter("graph_id % 4 = 0"), t.edges.filter("graph_id % 4 = 0"), MAP_PLAIN)
    return own.select((F.col("graph_id") / 4).cast("long").alias("query_id"), F.col("graph_embedding").alias("vector"))


@query(
    "rank_candidates",
    f"{_SCORED} SELECT query_id, CAST(rk AS INTEGER) AS rank, cand_id, {sql_r6('sim')} AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, cand_id) AS rk FROM sims) WHERE rk <= 2",
)
def _(t):
    nodes, edges = _grouped(t)
    return D.rank_candidates(_query_vectors(t), nodes, edges, MAP_PLAIN, 2).select("query_id", "rank", "cand_id", r6("sim").alias("sim"))


_PARTS = "sc AS (SELECT p_size AS query_id, p_partkey AS cand_id, p_retailprice AS sim, length(p_name) AS size FROM part)"
_KEEP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY sim DESC, cand_id) AS r FROM sc) WHERE r <= {a}), rest AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY {k} ORDER BY md5(concat_ws('|', '5', s.query_id, s.cand_id)), s.cand_id) AS r FROM sc s ANTI JOIN top USING (query_id, cand_id)) WHERE r <= {b})"


def _scored_parts(t):
    return t.read("part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("cand_id"), F.col("p_retailprice").alias("sim"), F.length("p_name").alias("size"))


@query("prune_candidates", f"WITH {_PARTS}, {_KEEP.format(k='query_id', a=15, b=5)} SELECT query_id, cand_id FROM top UNION ALL SELECT query_id, cand_id FROM rest")
def _(t):
    return D.prune_candidates(_scored_parts(t), 20, 0.25, 5).select("query_id", "cand_id")


@query("prune_candidates_by_size", f"WITH {_PARTS}, {_KEEP.format(k='query_id, size', a=3, b=1)} SELECT query_id, cand_id, size FROM top UNION ALL SELECT query_id, cand_id, size FROM rest")
def _(t):
    return D.prune_candidates(_scored_parts(t), 4, 0.25, 5, by_size=True).select("query_id", "cand_id", F.col("size").cast("long").alias("size"))


@query(
    "residual_target",
    f"""{WITH}, {_CB}, {map_layers(2, False)}, emb AS (SELECT graph_id, d, sum(v) AS v FROM alls GROUP BY ALL),
    lo AS (SELECT e.graph_id, a.d, sum(a.v * b.v) AS v FROM edges e JOIN idx_nodes m ON m.graph_id = e.graph_id AND m.node_id = e.src JOIN idx_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst
      JOIN cb a ON a.idx = m.idx JOIN cb b ON b.idx = n.idx AND b.d = a.d WHERE e.src > 1 GROUP BY ALL)
    SELECT emb.graph_id, emb.d, CAST(emb.v - coalesce(lo.v, 0) AS BIGINT) AS v FROM emb LEFT JOIN lo USING (graph_id, d)""",
)
def _(t):
    from braidvec.catalog.common import long_rows

    vectors = E.encode(t.nodes, t.edges, MAP_PLAIN).select("graph_id", F.col("graph_embedding").alias("vector"))
    left = E.encode_edge_multiset(E.edge_pair_counts(t.nodes, t.edges.filter("src > 1"), BINS), book(t, "MAP", 8))
    return long_rows(D.residual_target(vectors, left, key="graph_id"), ["graph_id"], "vector", integer=True)


@query(
    "best_of_n",
    """SELECT l_orderkey, arg_min(l_linenumber, s ORDER BY l_linenumber) AS best_item, min(s) AS best_score, coalesce(round(avg(s) FILTER (s < 'infinity'::DOUBLE), 6), 'infinity'::DOUBLE) AS avg_score
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'infinity'::DOUBLE ELSE l_quantity END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) GROUP BY ALL""".replace(
        "arg_min(l_linenumber, s ORDER BY l_linenumber)", "list(l_linenumber ORDER BY s, l_linenumber)[1]"
    ),
)
def _(t):
    score = F.when(F.col("l_quantity") > 45, float("inf")).otherwise(F.col("l_quantity"))
    out = D.best_of_n(t.read("lineitem"), "l_orderkey", "l_linenumber", score)
    return out.withColumn("avg_score", r6_scaled("avg_score"))


@query("nearest_entry", f"{WITH}, {_gram(WIDE)}, rk AS (SELECT graph_id, idx, row_number() OVER (PARTITION BY graph_id ORDER BY dot DESC, idx) AS r FROM dots) SELECT graph_id, idx, concat_ws(',', idx // 60, (idx // 10) % 6, (idx // 5) % 2, idx % 5) AS feat FROM rk WHERE r = 1")
def _(t):
    cb = make_codebook(t.spark, BINS, WIDE, "MAP", 42)
    near = D.nearest_entry(E.node_terms(t.nodes, cb), cb)
    return near.select("graph_id", "idx", text(feature_tuple("idx", BINS)).alias("feat"))


_PROBS = "[0.4, 0.3, 0.1, 0.1, 0.1]"


@query(
    "sample_edge_candidates",
    f"""{WITH}, pr AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id),
    dr AS (SELECT pr.graph_id AS query_id, pr.graph_id * 3 + s.s AS graph_id, src, dst, (CAST('0x' || substr(md5(concat_ws('|', '13', pr.graph_id, s.s, src, dst)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM pr, range(3) s(s)),
    c AS (SELECT query_id, graph_id, src, dst, CASE WHEN u < 0.4 THEN 0 WHEN u < 0.4 + 0.3 THEN 1 WHEN u < 0.4 + 0.3 + 0.1 THEN 2 WHEN u < 0.4 + 0.3 + 0.1 + 0.1 THEN 3 ELSE 4 END AS bond FROM dr)
    SELECT query_id, graph_id, src, dst, bond FROM c WHERE bond > 0 UNION ALL SELECT query_id, graph_id, dst, src, bond FROM c WHERE bond > 0""",
)
def _(t):
    from braidvec.operators.graphs import all_pairs

    probs = all_pairs(t.nodes).drop("bond").withColumn("probs", F.array(*[F.lit(p) for p in (0.4, 0.3, 0.1, 0.1, 0.1)]))
    return D.sample_edge_candidates(probs, 3, 13)


def _decoded_graphs(t):
    """Every order graph encoded, and decoded again from its two vectors."""
    cfg = EncoderConfig(bins=BINS, dim=WIDE, depth=3, vsa="HRR", seed=42)
    cb = book(t, "HRR", WIDE)
    settings = DecodeSettings(top_k=2, probe=8, rounds=1, samples=16, early_stopping=True)
    return decode_graph_of(t.nodes, t.edges, cfg, cb, _pairs(t).select("a", "b").distinct(), settings)


@query("decode_graph")
def _(t):
    """One row a ranked graph, and one a query without any."""
    out = _decoded_graphs(t)
    joined = out.states.join(out.ranked, "query_id", "left")
    return joined.withColumns({"sim": r6("sim"), "best_sim": r6("best_sim")})
