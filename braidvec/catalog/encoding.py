"""Queries that encode the order graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidvec.catalog.algebra import book
from braidvec.catalog.common import BINS, ROWS, long_rows
from braidvec.catalog.registry import query
from braidvec.catalog.relations import _RW_SQL, _pagerank_sql
from braidvec.catalog.sqltext import WITH, fhrr_codebook, hrr_codebook, map_codebook, r6 as sql_r6
from braidvec.functions import batch as B
from braidvec.operators import encode as E
from braidvec.operators import graphs as G
from braidvec.operators.walks import augment_rw
from braidvec.schema import EncoderConfig, WalkConfig

SEED, DIM = 42, 8
MAP_PLAIN = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="MAP", seed=SEED, normalize=False)
MAP_UNIT = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="MAP", seed=SEED, normalize=True)


def map_layers(depth: int, normalize: bool, book_name: str = "cb", prefix: str = "s", edges: str = "edges", weight: str = "1", identity: bool = False) -> str:
    """Layer states (graph_id, node_id, d, v) of a MAP encoder in long form."""
    empty = f"CASE WHEN d{prefix}.degree IS NULL THEN 1 ELSE 0 END" if identity else "0"
    parts = [f"{prefix}0 AS (SELECT n.graph_id, n.node_id, c.d, c.v::DOUBLE AS v FROM idx_nodes n JOIN {book_name} c USING (idx))"]
    for k in range(1, depth + 1):
        parts.append(
            f"a{prefix}{k} AS (SELECT e.graph_id, e.src AS node_id, p.d, sum(p.v * {weight}) AS v FROM {edges} e JOIN {prefix}{k - 1} p ON p.graph_id = e.graph_id AND p.node_id = e.dst GROUP BY ALL), "
            f"b{prefix}{k} AS (SELECT p.graph_id, p.node_id, p.d, p.v * coalesce(a.v, {empty}) AS v FROM {prefix}{k - 1} p LEFT JOIN a{prefix}{k} a USING (graph_id, node_id, d) "
            f"LEFT JOIN deg d{prefix} ON d{prefix}.graph_id = p.graph_id AND d{prefix}.node_id = p.node_id), "
        )
        if normalize:
            parts[-1] += f"{prefix}{k} AS MATERIALIZED (SELECT graph_id, node_id, d, v / (sqrt(sum(v * v) OVER (PARTITION BY graph_id, node_id)) + 1e-8) AS v FROM b{prefix}{k})"
        else:
            parts[-1] += f"{prefix}{k} AS MATERIALIZED (SELECT * FROM b{prefix}{k})"
    union = " UNION ALL ".join(f"SELECT * FROM {prefix}{k}" for k in range(depth + 1))
    parts.append(f"all{prefix} AS ({union})")
    return ", ".join(parts)


_CB = map_codebook("cb", ROWS, DIM, SEED)


def _parts_sql(prefix: str = "s") -> str:
    return f"""SELECT 'node' AS part, graph_id, d, {sql_r6('sum(v)')} AS v FROM {prefix}0 GROUP BY ALL UNION ALL SELECT 'edge', graph_id, d, {sql_r6('sum(v)')} FROM b{prefix}1 GROUP BY ALL
    UNION ALL SELECT 'graph', graph_id, d, {sql_r6('sum(v)')} FROM all{prefix} GROUP BY ALL"""


def _three(encoded):
    """The three vectors in long form, from one encoding: a union of three would encode three times."""
    parts = [F.struct(F.lit(name).alias("part"), F.col(c).alias("v")) for name, c in (("node", "node_terms"), ("edge", "edge_terms"), ("graph", "graph_embedding"))]
    rows = encoded.select("graph_id", F.explode(F.array(*parts)).alias("_p")).select("graph_id", "_p.part", F.col("_p.v").alias("_vector"))
    return long_rows(rows, ["graph_id", "part"], "_vector").select("graph_id", "d", "v", "part")


@query("node_terms", f"{WITH}, {_CB} SELECT n.graph_id, cb.d, CAST(sum(v) AS BIGINT) AS v FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    return long_rows(E.node_terms(t.nodes, book(t, "MAP", DIM)), ["graph_id"], "node_terms", integer=True)


@query(
    "edge_terms",
    f"""{WITH}, {_CB}, x AS (SELECT e.graph_id, a.d, sum(a.v * b.v) AS v FROM edges e JOIN idx_nodes m ON m.graph_id = e.graph_id AND m.node_id = e.src JOIN idx_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst
      JOIN cb a ON a.idx = m.idx JOIN cb b ON b.idx = n.idx AND b.d = a.d GROUP BY ALL)
    SELECT g.graph_id, r.d, CAST(coalesce(x.v, 0) AS BIGINT) AS v FROM (SELECT DISTINCT graph_id FROM nodes) g CROSS JOIN range({DIM}) r(d) LEFT JOIN x ON x.graph_id = g.graph_id AND x.d = r.d""",
)
def _(t):
    return long_rows(E.edge_terms(t.nodes, t.edges, book(t, "MAP", DIM)), ["graph_id"], "edge_terms", integer=True)


@query("encode", f"{WITH}, {_CB}, {map_layers(2, True)} {_parts_sql()}")
def _(t):
    return _three(E.encode(t.nodes, t.edges, MAP_UNIT))


@query("encode_plain", f"{WITH}, {_CB}, {map_layers(2, False)} {_parts_sql()}")
def _(t):
    return _three(E.encode(t.nodes, t.edges, MAP_PLAIN))


@query("encode_identity", f"{WITH}, {_CB}, {map_layers(2, False, identity=True)} {_parts_sql()}")
def _(t):
    cfg = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="MAP", seed=SEED, normalize=False, isolated="identity")
    return _three(E.encode(t.nodes, t.edges, cfg))


_DFT = f"sp AS (SELECT cb.idx, k.d, sum(cb.v * cos(2 * pi() * cb.d * k.d / {DIM})) AS re, -sum(cb.v * sin(2 * pi() * cb.d * k.d / {DIM})) AS im FROM cb CROSS JOIN range({DIM}) k(d) GROUP BY ALL)"


def _complex_layers(depth: int, source: str, parseval: int) -> str:
    parts = [f"s0 AS (SELECT n.graph_id, n.node_id, c.d, c.re, c.im FROM idx_nodes n JOIN {source} c USING (idx))"]
    for k in range(1, depth + 1):
        parts.append(
            f"a{k} AS (SELECT e.graph_id, e.src AS node_id, p.d, sum(p.re) AS re, sum(p.im) AS im FROM edges e JOIN s{k - 1} p ON p.graph_id = e.graph_id AND p.node_id = e.dst GROUP BY ALL), "
            f"b{k} AS (SELECT p.graph_id, p.node_id, p.d, p.re * coalesce(a.re, 0) - p.im * coalesce(a.im, 0) AS re, p.re * coalesce(a.im, 0) + p.im * coalesce(a.re, 0) AS im "
            f"FROM s{k - 1} p LEFT JOIN a{k} a USING (graph_id, node_id, d)), "
            f"s{k} AS MATERIALIZED (SELECT graph_id, node_id, d, re / l AS re, im / l AS im FROM (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY graph_id, node_id) / {parseval}) + 1e-8 AS l FROM b{k}))"
        )
    union = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(depth + 1))
    parts.append(f"al AS (SELECT graph_id, d, sum(re) AS re, sum(im) AS im FROM ({union}) GROUP BY ALL)")
    return ", ".join(parts)


@query(
    "encode_hrr",
    f"""{WITH}, {hrr_codebook('cb', ROWS, DIM, SEED)}, {_DFT}, {_complex_layers(2, 'sp', DIM)}
    SELECT al.graph_id, k.d, {sql_r6(f'sum(re * cos(2 * pi() * al.d * k.d / {DIM}) - im * sin(2 * pi() * al.d * k.d / {DIM})) / {DIM}')} AS v FROM al CROSS JOIN range({DIM}) k(d) GROUP BY ALL""",
)
def _(t):
    cfg = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="HRR", seed=SEED)
    return long_rows(E.encode(t.nodes, t.edges, cfg), ["graph_id"], "graph_embedding")


@query("encode_fhrr", f"{WITH}, {fhrr_codebook('cb', ROWS, DIM, SEED)}, {_complex_layers(2, 'cb', 1)} SELECT graph_id, d, {sql_r6('re')} AS re, {sql_r6('im')} AS im FROM al")
def _(t):
    from braidvec.catalog.algebra import _cells

    cfg = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="FHRR", seed=SEED)
    return _cells(E.encode(t.nodes, t.edges, cfg).select("graph_id", F.col("graph_embedding").alias("hv")), ["graph_id"])


_WALK = WalkConfig(ks=(6,), num_bins=4)


@query(
    "encode_split_rw",
    f"""{_RW_SQL}, fullx AS (SELECT n.graph_id, n.node_id, n.idx * 4 + least(greatest(CAST(trunc(w.p::FLOAT * 4::FLOAT) AS INTEGER), 0), 3) AS fidx FROM idx_nodes n JOIN rw w ON w.graph_id = n.graph_id AND w.node_id = n.node_id AND w.k = 6),
    {map_codebook('cf', ROWS * 4, DIM, SEED + 1000)}, {_CB}, {map_layers(2, False)}
    SELECT 'node' AS part, f.graph_id, cf.d, {sql_r6('sum(cf.v)')} AS v FROM fullx f JOIN cf ON cf.idx = f.fidx GROUP BY ALL UNION ALL SELECT 'graph', graph_id, d, {sql_r6('sum(v)')} FROM alls GROUP BY ALL""",
)
def _(t):
    cfg = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="MAP", seed=SEED, normalize=False, walk=_WALK)
    return _three(E.encode_split_rw(augment_rw(t.nodes, t.edges, _WALK), t.edges, cfg)).filter("part <> 'edge'")


@query(
    "encode_dataset_walks",
    f"""{_RW_SQL}, fullx AS (SELECT n.graph_id, n.node_id, n.idx * 4 + least(greatest(CAST(trunc(w.p::FLOAT * 4::FLOAT) AS INTEGER), 0), 3) AS fidx FROM idx_nodes n JOIN rw w ON w.graph_id = n.graph_id AND w.node_id = n.node_id AND w.k = 6),
    {map_codebook('cf', ROWS * 4, DIM, SEED + 1000)}, {_CB}, {map_layers(2, False)},
    x AS (SELECT e.graph_id, a.d, sum(a.v * b.v) AS v FROM edges e JOIN idx_nodes m ON m.graph_id = e.graph_id AND m.node_id = e.src JOIN idx_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst
      JOIN cb a ON a.idx = m.idx JOIN cb b ON b.idx = n.idx AND b.d = a.d GROUP BY ALL)
    SELECT 'node' AS part, f.graph_id, cf.d, {sql_r6('sum(cf.v)')} AS v FROM fullx f JOIN cf ON cf.idx = f.fidx GROUP BY ALL UNION ALL SELECT 'graph', graph_id, d, {sql_r6('sum(v)')} FROM alls GROUP BY ALL
    UNION ALL SELECT 'edge', g.graph_id, r.d, {sql_r6('coalesce(x.v, 0)')} FROM (SELECT DISTINCT graph_id FROM nodes) g CROSS JOIN range({DIM}) r(d) LEFT JOIN x ON x.graph_id = g.graph_id AND x.d = r.d""",
)
def _(t):
    """All three parts, walk features computed on the way."""
    cfg = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="MAP", seed=SEED, normalize=False, walk=_WALK)
    return _three(E.encode_dataset(t.nodes, t.edges, cfg))


ENSEMBLE_SQL = f"""{WITH}, {_CB}, {map_codebook('cc', ROWS, 4, SEED + 1)}, {map_layers(2, True)}, {map_layers(1, True, 'cc', 'q')}
    SELECT graph_id, d, {sql_r6('sum(v)')} AS v FROM alls GROUP BY ALL UNION ALL SELECT graph_id, d + {DIM}, {sql_r6('sum(v)')} FROM allq GROUP BY ALL"""


@query("encode_ensemble", ENSEMBLE_SQL)
def _(t):
    cfg = EncoderConfig(bins=BINS, dim=DIM, vsa="MAP", seed=SEED, members=((DIM, 2), (4, 1)))
    return long_rows(E.encode_ensemble(t.nodes, t.edges, cfg), ["graph_id"], "graph_embedding")


@query(
    "encode_edge_multiset",
    f"""{WITH}, {_CB}, x AS (SELECT e.graph_id, a.d, sum(a.v * b.v) AS v FROM edges e JOIN idx_nodes m ON m.graph_id = e.graph_id AND m.node_id = e.src JOIN idx_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst
      JOIN cb a ON a.idx = m.idx JOIN cb b ON b.idx = n.idx AND b.d = a.d GROUP BY ALL)
    SELECT g.graph_id, r.d, CAST(coalesce(x.v, 0) AS BIGINT) AS v FROM (SELECT DISTINCT o_orderkey AS graph_id FROM orders) g CROSS JOIN range({DIM}) r(d) LEFT JOIN x ON x.graph_id = g.graph_id AND x.d = r.d""",
)
def _(t):
    counts = E.edge_pair_counts(t.nodes, t.edges, BINS)
    every = t.read("orders").select(F.col("o_orderkey").alias("graph_id")).distinct()
    return long_rows(E.encode_edge_multiset(counts, book(t, "MAP", DIM), keys=every), ["graph_id"], "edge_vector", integer=True)


@query("encode_soft", f"{WITH}, {_CB}, soft AS (SELECT *, 1.0 / (1 + src + dst) AS w FROM edges), {map_layers(2, True, edges='soft', weight='e.w')} {_parts_sql()}")
def _(t):
    soft = t.edges.withColumn("weight", 1.0 / (1 + F.col("src") + F.col("dst")))
    return _three(E.encode_soft(t.nodes, soft, MAP_UNIT))


@query(
    "encode_weighted_readout",
    f"{WITH}, {_CB}, {map_layers(2, True)}, {_pagerank_sql()} SELECT a.graph_id, a.d, {sql_r6('sum(a.v * r20.r)')} AS v FROM alls a JOIN r20 USING (graph_id, node_id) GROUP BY ALL",
)
def _(t):
    weights = G.pagerank(t.nodes, t.edges).withColumnRenamed("pagerank", "weight")
    return long_rows(E.encode_weighted_readout(t.nodes, t.edges, weights, MAP_UNIT), ["graph_id"], "graph_embedding")


@query("encode_ensemble_files", ENSEMBLE_SQL)
def _(t):
    """With the configuration and the member codebooks written to files and loaded again."""
    from braidvec.catalog.sources import scratch
    from braidvec.sources import io

    folder = scratch(t)
    made = EncoderConfig(bins=BINS, dim=DIM, vsa="MAP", seed=SEED, kind="ensemble", members=((DIM, 2), (4, 1)))
    io.save_encoder(folder, made, io.encoder_codebooks(t.spark, made), t.spark)
    cfg, books = io.load_encoder(t.spark, folder, "ensemble")
    return long_rows(E.encode_ensemble(t.nodes, t.edges, cfg, books=books), ["graph_id"], "graph_embedding")


_WIDE = 256


@query(
    "encode_map_d256",
    f"{WITH}, {map_codebook('cw', ROWS, _WIDE, SEED)}, {map_layers(2, False, 'cw')}, w AS (SELECT graph_id, d, CAST(sum(v) AS BIGINT) AS v FROM alls GROUP BY ALL) "
    "SELECT graph_id, CAST(sum(v * (1 + d * 37 % 101)) AS BIGINT) AS checksum, CAST(sum(v * v) AS BIGINT) AS squares FROM w GROUP BY ALL",
)
def _(t):
    """At a vector size of practical use; every entry counts in the sums."""
    cfg = EncoderConfig(bins=BINS, dim=_WIDE, depth=2, vsa="MAP", seed=SEED, normalize=False)
    return E.encode(t.nodes, t.edges, cfg, terms=False).mapInArrow(_digests, "graph_id long, checksum long, squares long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sum and sum of squares of the rounded entries of every vector."""
    for batch in batches:
        v = np.rint(B.vector_rows(batch.column("graph_embedding"))).astype(np.int64)
        weight = 1 + np.arange(v.shape[1]) * 37 % 101
        yield pa.RecordBatch.from_arrays([batch.column("graph_id"), pa.array((v * weight).sum(axis=1)), pa.array((v * v).sum(axis=1))], ["graph_id", "checksum", "squares"])


@query("encode_dataset", f"{WITH}, {_CB}, {map_layers(2, True)} {_parts_sql()}")
def _(t):
    import uuid

    from braidvec.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(t.spark)}/encoded-{uuid.uuid4().hex}"
    return _three(E.encode_dataset(t.nodes, t.edges, MAP_UNIT, folder))
