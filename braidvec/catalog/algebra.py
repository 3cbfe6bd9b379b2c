"""Queries over hypervectors and codebooks. Every one reads vectors that belong to rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.common import BINS, ROWS, long_rows, r6, text
from braidvec.catalog.registry import query
from braidvec.catalog.sqltext import WITH, fhrr_codebook, hrr_codebook, map_codebook, r6 as sql_r6
from braidvec.functions import vsa as V
from braidvec.functions.features import feature_tuple
from braidvec.operators import codebook as C
from braidvec.operators import encode as E

SEED, DIM = 42, 16


def book(t, vsa: str, dim: int = DIM, seed: int = SEED):
    """Codebook over the order bins, kept to the tuples that occur in the data."""
    full = C.make_codebook(t.spark, BINS, dim, vsa, seed)
    return C.prune_codebook(full, t.nodes.select("feat").distinct())


def _cells(df, keys):
    z = F.arrays_zip(F.col("hv.re").alias("re"), F.col("hv.im").alias("im"))
    cells = df.select(*keys, F.posexplode(z).alias("d", "z"))
    return cells.select(*keys, F.col("d").cast("long").alias("d"), r6("z.re").alias("re"), r6("z.im").alias("im"))


_USED = f"{WITH}, used AS (SELECT DISTINCT idx, feat FROM idx_nodes)"


@query("make_codebook", f"{_USED}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT cb.idx, cb.d, CAST(v AS BIGINT) AS v FROM cb JOIN used USING (idx)")
def _(t):
    return long_rows(book(t, "MAP").table, ["idx"], "hv", integer=True)


@query("make_codebook_hrr", f"{_USED}, {hrr_codebook('cb', ROWS, DIM, SEED)} SELECT cb.idx, cb.d, {sql_r6('v')} AS v FROM cb JOIN used USING (idx)")
def _(t):
    return long_rows(book(t, "HRR").table, ["idx"], "hv")


@query("make_codebook_fhrr", f"{_USED}, {fhrr_codebook('cb', ROWS, DIM, SEED)} SELECT cb.idx, cb.d, {sql_r6('re')} AS re, {sql_r6('im')} AS im FROM cb JOIN used USING (idx)")
def _(t):
    return _cells(book(t, "FHRR").table, ["idx"])


@query(
    "prune_codebook",
    f"{_USED} SELECT idx, feat, row_number() OVER (ORDER BY idx) - 1 AS pos FROM used",
)
def _(t):
    return book(t, "MAP").table.select("idx", text().alias("feat"), "pos")


@query("rebuild_codebook", f"{WITH}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT n.graph_id, n.node_id, CAST(sum(v) AS BIGINT) AS total FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    full = C.rebuild_codebook(book(t, "MAP"), SEED)
    looked = C.lookup_hv(t.nodes, full)
    return looked.select("graph_id", "node_id", F.aggregate("hv", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))


@query("lookup_hv", f"{WITH}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT n.graph_id, n.node_id, string_agg(CASE v WHEN 1 THEN '+' ELSE '-' END, '' ORDER BY d) AS hv FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    signs = F.array_join(F.transform("hv", lambda v: F.when(v > 0, "+").otherwise("-")), "")
    return C.lookup_hv(t.nodes, book(t, "MAP")).select("graph_id", "node_id", signs.alias("hv"))


@query("lookup_edge_hv", f"{WITH}, {map_codebook('cb', 5, DIM, 7)} SELECT b.graph_id, b.src, b.dst, CAST(sum(v * (d + 1)) AS BIGINT) AS code FROM bonds b JOIN cb ON cb.idx = b.bond GROUP BY ALL")
def _(t):
    looked = C.lookup_edge_hv(t.bonds, C.make_codebook(t.spark, (5,), DIM, "MAP", 7))
    return looked.select("graph_id", "src", "dst", F.aggregate(F.transform("hv", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).cast("long").alias("code"))


@query("lookup_graph_hv", f"WITH {map_codebook('cb', 5, DIM, 9)} SELECT o_orderkey AS graph_id, CAST(sum(v * (d + 1)) AS BIGINT) AS code FROM orders JOIN cb ON cb.idx = CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 GROUP BY ALL")
def _(t):
    graphs = t.read("orders").select(F.col("o_orderkey").alias("graph_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"))
    looked = C.lookup_graph_hv(graphs, C.make_codebook(t.spark, (5,), DIM, "MAP", 9))
    return looked.select("graph_id", F.aggregate(F.transform("hv", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).cast("long").alias("code"))


_PAIR = f"{WITH}, p AS (SELECT e.graph_id, e.src, e.dst, a.idx AS ia, b.idx AS ib FROM edges e JOIN idx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN idx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"


def _edge_vectors(t, cb):
    looked = C.lookup_hv(t.nodes, cb).select("graph_id", "node_id", "hv")
    left = looked.select("graph_id", F.col("node_id").alias("src"), F.col("hv").alias("ha"))
    right = looked.select("graph_id", F.col("node_id").alias("dst"), F.col("hv").alias("hb"))
    return t.edges.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"])


@query("bind", f"{_PAIR}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT p.graph_id, p.src, p.dst, CAST(sum(a.v * b.v * (a.d + 1)) AS BIGINT) AS code FROM p JOIN cb a ON a.idx = p.ia JOIN cb b ON b.idx = p.ib AND b.d = a.d GROUP BY ALL")
def _(t):
    bound = _edge_vectors(t, book(t, "MAP")).withColumn("h", V.bind("ha", "hb"))
    weighed = F.aggregate(F.transform("h", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return bound.select("graph_id", "src", "dst", weighed.cast("long").alias("code"))


# Circular convolution of the pair vectors that occur: index (k - i) mod 16.
_CONV = f"""conv AS (SELECT q.ia, q.ib, k.d AS d, sum(a.v * b.v) AS v FROM (SELECT DISTINCT ia, ib FROM p) q CROSS JOIN range({DIM}) k(d)
  JOIN cb a ON a.idx = q.ia JOIN cb b ON b.idx = q.ib AND b.d = (k.d - a.d + {DIM}) % {DIM} GROUP BY ALL)"""


@query("bind_hrr", f"{_PAIR}, {hrr_codebook('cb', ROWS, DIM, SEED)}, {_CONV} SELECT ia AS a, ib AS b, d, {sql_r6('v')} AS v FROM conv")
def _(t):
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    bound = C.pair_codebook(pairs, book(t, "HRR"))
    return long_rows(bound.withColumn("hv", V.from_spectral("hv")), ["a", "b"], "hv")


@query("circular_convolve", f"{_PAIR}, {hrr_codebook('cb', ROWS, DIM, SEED)}, {_CONV} SELECT ia AS a, ib AS b, d, {sql_r6('v')} AS v FROM conv")
def _(t):
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    cb = book(t, "HRR")
    left = cb.joinable().select(F.col("idx").alias("a"), F.col("hv").alias("ha"))
    right = cb.joinable().select(F.col("idx").alias("b"), F.col("hv").alias("hb"))
    joined = pairs.join(left, "a").join(right, "b")
    return long_rows(joined.withColumn("hv", V.circular_convolve("ha", "hb")), ["a", "b"], "hv")


@query(
    "bind_fhrr",
    f"""{_PAIR}, {fhrr_codebook('cb', ROWS, DIM, SEED)} SELECT q.ia AS a, q.ib AS b, a.d, {sql_r6('a.re * b.re - a.im * b.im')} AS re, {sql_r6('a.re * b.im + a.im * b.re')} AS im
    FROM (SELECT DISTINCT ia, ib FROM p) q JOIN cb a ON a.idx = q.ia JOIN cb b ON b.idx = q.ib AND b.d = a.d""",
)
def _(t):
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    return _cells(C.pair_codebook(pairs, book(t, "FHRR")), ["a", "b"])


@query("pair_codebook", f"{_PAIR}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT q.ia AS a, q.ib AS b, a.d, CAST(a.v * b.v AS BIGINT) AS v FROM (SELECT DISTINCT ia, ib FROM p) q JOIN cb a ON a.idx = q.ia JOIN cb b ON b.idx = q.ib AND b.d = a.d")
def _(t):
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    return long_rows(C.pair_codebook(pairs, book(t, "MAP")), ["a", "b"], "hv", integer=True)


@query("bundle", f"{WITH}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT n.graph_id, cb.d, CAST(sum(v) AS BIGINT) AS v FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    return long_rows(E.bundle(C.lookup_hv(t.nodes, book(t, "MAP")), ["graph_id"]), ["graph_id"], "hv", integer=True)


@query("unbind", f"{_PAIR}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT p.graph_id, p.src, p.dst, CAST(sum(b.v * (b.d + 1)) AS BIGINT) AS code FROM p JOIN cb b ON b.idx = p.ib GROUP BY ALL")
def _(t):
    bound = _edge_vectors(t, book(t, "MAP")).withColumn("h", V.unbind(V.bind("ha", "hb"), F.col("ha")))
    weighed = F.aggregate(F.transform("h", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return bound.select("graph_id", "src", "dst", weighed.cast("long").alias("code"))


@query("unbind_spectral", f"{_PAIR}, {hrr_codebook('cb', ROWS, DIM, SEED)} SELECT q.ia AS a, q.ib AS b, cb.d, {sql_r6('v')} AS v FROM (SELECT DISTINCT ia, ib FROM p) q JOIN cb ON cb.idx = q.ib")
def _(t):
    pairs = E.edge_pair_counts(t.nodes, t.edges, BINS).select("a", "b").distinct()
    cb = book(t, "HRR").spectral()
    bound = C.pair_codebook(pairs, cb).join(cb.joinable().select(F.col("idx").alias("a"), F.col("hv").alias("f")), "a")
    return long_rows(bound.withColumn("hv", V.from_spectral(V.unbind("hv", "f", "HRR"))), ["a", "b"], "hv")


_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * {}.embedding[i]::DOUBLE))"


def _neighbours(t):
    e = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("l2_normalize", f"SELECT a.vec_id, CAST(i - 1 AS BIGINT) AS d, {sql_r6(f'embedding[i]::DOUBLE / (sqrt({_DOT.format(chr(97))}) + 1e-8)')} AS v FROM embeddings a, range(1, 65) r(i)")
def _(t):
    e = t.read("embeddings").select("vec_id", V.l2_normalize(F.col("embedding").cast("array<double>")).alias("v"))
    return long_rows(e, ["vec_id"], "v")


@query("dot", f"SELECT a.vec_id, {sql_r6(_DOT.format('b'))} AS v {_NEXT}")
def _(t):
    return _neighbours(t).select("vec_id", r6(V.dot("a", "b")).alias("v"))


@query("cosine", f"SELECT a.vec_id, {sql_r6(_DOT.format('b') + ' / sqrt(' + _DOT.format('a') + ') / sqrt(list_sum(list_transform(range(1, 65), lambda i: b.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)))')} AS v {_NEXT}")
def _(t):
    return _neighbours(t).select("vec_id", r6(V.cosine("a", "b")).alias("v"))


@query("sq_dist", f"SELECT a.vec_id, {sql_r6('list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))')} AS v {_NEXT}")
def _(t):
    return _neighbours(t).select("vec_id", r6(V.sq_dist("a", "b")).alias("v"))


@query("identity", f"{WITH}, {map_codebook('cb', ROWS, DIM, SEED)} SELECT n.graph_id, n.node_id, true AS map_same, CAST(sum(v * (d + 1)) AS BIGINT) AS code FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    looked = C.lookup_hv(t.nodes, book(t, "MAP")).withColumn("h", V.bind("hv", V.identity("MAP", DIM)))
    weighed = F.aggregate(F.transform("h", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return looked.select("graph_id", "node_id", (F.col("h") == F.col("hv")).alias("map_same"), weighed.cast("long").alias("code"))


@query(
    "cartesian_bind",
    f"""{WITH}, {map_codebook('x', 3, DIM, 1)}, {map_codebook('y', 6, DIM, 2)}, {map_codebook('z', 2, DIM, 3)}
    SELECT n.graph_id, n.node_id, CAST(sum(x.v * y.v * z.v * (x.d + 1)) AS BIGINT) AS code FROM nodes n JOIN x ON x.idx = n.f0 JOIN y ON y.idx = n.f1 AND y.d = x.d JOIN z ON z.idx = n.f2 AND z.d = x.d GROUP BY ALL""",
)
def _(t):
    books = [C.make_codebook(t.spark, (b,), DIM, "MAP", s) for b, s in ((3, 1), (6, 2), (2, 3))]
    looked = C.lookup_hv(t.nodes.withColumn("feat", F.slice("feat", 1, 3)), C.cartesian_bind(books))
    weighed = F.aggregate(F.transform("hv", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return looked.select("graph_id", "node_id", weighed.cast("long").alias("code"))


_DFT = f"dft AS (SELECT cb.idx, k.d, sum(cb.v * cos(2 * pi() * cb.d * k.d / {DIM})) AS re, -sum(cb.v * sin(2 * pi() * cb.d * k.d / {DIM})) AS im FROM cb CROSS JOIN range({DIM}) k(d) GROUP BY ALL)"


@query("to_spectral", f"{_USED}, {hrr_codebook('cb', ROWS, DIM, SEED)}, {_DFT} SELECT dft.idx, dft.d, {sql_r6('re')} AS re, {sql_r6('im')} AS im FROM dft JOIN used USING (idx)")
def _(t):
    return _cells(book(t, "HRR").spectral().table, ["idx"])


@query("from_spectral", f"{_USED}, {hrr_codebook('cb', ROWS, DIM, SEED)} SELECT cb.idx, cb.d, {sql_r6('v')} AS v FROM cb JOIN used USING (idx)")
def _(t):
    back = book(t, "HRR").spectral().table.withColumn("hv", V.from_spectral("hv"))
    return long_rows(back, ["idx"], "hv")


@query("feature_tuple_roundtrip", f"{_USED} SELECT idx, feat FROM used")
def _(t):
    return book(t, "MAP").table.select("idx", text(feature_tuple("idx", BINS)).alias("feat"))
