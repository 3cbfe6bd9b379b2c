"""Queries over distances, fingerprints and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.common import r6
from braidvec.catalog.registry import query
from braidvec.catalog.relations import wl_sql
from braidvec.catalog.sqltext import WITH, r6 as sql_r6
from braidvec.operators import similarity as S

_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _cos(lo: int, hi: int) -> str:
    x, y = f"a.embedding[{lo}:{hi}]::DOUBLE[]", f"b.embedding[{lo}:{hi}]::DOUBLE[]"
    return f"list_cosine_similarity({x}, {y})"


def vectors(t):
    return t.read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _neighbours(t):
    e = vectors(t)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


@query("cosine_distance", f"SELECT a.vec_id, {sql_r6('1 - ' + _cos(1, 64))} AS d_all, {sql_r6('1 - ' + _cos(33, 64))} AS d_graph {_PAIRS}")
def _(t):
    return _neighbours(t).select("vec_id", r6(S.cosine_distance("v", "w")).alias("d_all"), r6(S.cosine_distance("v", "w", 32)).alias("d_graph"))


@query("ensemble_distance", f"SELECT a.vec_id, {sql_r6(f'((1 - {_cos(1, 32)}) + (1 - {_cos(33, 48)}) + (1 - {_cos(49, 64)})) / 3')} AS d {_PAIRS}")
def _(t):
    return _neighbours(t).select("vec_id", r6(S.ensemble_distance("v", "w", [32, 16, 16])).alias("d"))


@query(
    "mean_pairwise_cosine",
    f"SELECT (SELECT count(*) FROM embeddings) AS n, {sql_r6('avg(c)')} AS mean, {sql_r6('stddev_samp(c)')} AS std FROM (SELECT {_cos(1, 64)} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)",
)
def _(t):
    return S.mean_pairwise_cosine(vectors(t), "v").select("n", r6("mean").alias("mean"), r6("std").alias("std"))


_FP = f"""{wl_sql(2)}, fpl AS (SELECT graph_id, label FROM w0 UNION ALL SELECT graph_id, label FROM w1 UNION ALL SELECT graph_id, label FROM w2),
fp AS (SELECT DISTINCT graph_id, CAST(CAST('0x' || substr(label, 1, 13) AS BIGINT) % 2048 AS INTEGER) AS bit FROM fpl)"""


@query("circular_fingerprint", f"{WITH}, {_FP} SELECT graph_id, string_agg(bit, ',' ORDER BY bit) AS bits FROM fp GROUP BY ALL")
def _(t):
    fp = S.circular_fingerprint(t.nodes, t.edges)
    return fp.select("graph_id", F.concat_ws(",", F.col("bits").cast("array<string>")).alias("bits"))


@query(
    "tanimoto",
    f"""{WITH}, {_FP}, s AS (SELECT graph_id, list(bit) AS bits FROM fp GROUP BY ALL)
    SELECT a.graph_id, round(len(list_intersect(a.bits, b.bits)) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))), 6) AS sim FROM s a JOIN s b ON b.graph_id = a.graph_id + 1""",
)
def _(t):
    fp = S.circular_fingerprint(t.nodes, t.edges)
    after = fp.select((F.col("graph_id") - 1).alias("graph_id"), F.col("bits").alias("other"))
    return fp.join(after, "graph_id").select("graph_id", F.round(S.tanimoto("bits", "other"), 6).alias("sim"))


_WORDS = """wb AS (SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 13) AS BIGINT) % 2048 AS INTEGER) AS bit FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> ''),
sz AS (SELECT doc_id, count(*) AS k FROM wb GROUP BY ALL), co AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM wb a JOIN wb b ON a.bit = b.bit AND a.doc_id < b.doc_id GROUP BY ALL)"""


def word_bits(t):
    """Set of hashed words of each document, as a fingerprint."""
    from braidvec.functions.hashing import hex_number

    words = t.read("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).filter("w <> ''")
    bits = words.select("doc_id", F.pmod(hex_number(F.md5("w")), F.lit(2048)).cast("int").alias("bit"))
    return bits.groupBy("doc_id").agg(F.collect_set("bit").alias("bits"))


@query(
    "internal_diversity",
    f"WITH {_WORDS}, n AS (SELECT count(*) AS n FROM sz) SELECT n.n, round(100 * (1 - sum(co.c / (a.k + b.k - co.c)) / (n.n * (n.n - 1) / 2.0)), 6) AS diversity FROM n, co JOIN sz a ON a.doc_id = co.x JOIN sz b ON b.doc_id = co.y GROUP BY n.n",
)
def _(t):
    return S.internal_diversity(word_bits(t)).select("n", F.round("diversity", 6).alias("diversity"))


# Equal fingerprints are merged; the others meet as bit strings.
@query(
    "internal_diversity_graphs",
    f"""{WITH}, {_FP}, s AS (SELECT graph_id, list_sort(list(bit)) AS bits FROM fp GROUP BY ALL), m AS MATERIALIZED (SELECT bits, count(*) AS w, len(bits) AS k, row_number() OVER () AS r FROM s GROUP BY bits),
    b AS MATERIALIZED (SELECT r, w, k, unnest(bits) AS bit FROM m), f AS MATERIALIZED (SELECT r, any_value(w) AS w, any_value(k) AS k, bitstring_agg(bit, 0, 2047) AS f FROM b GROUP BY r),
    p AS (SELECT sum(CASE WHEN x.r = y.r THEN x.w * (x.w - 1) / 2.0 ELSE x.w * y.w * bit_count(x.f & y.f) / (x.k + y.k - bit_count(x.f & y.f))::DOUBLE END) AS s FROM f x JOIN f y ON x.r <= y.r), n AS (SELECT sum(w) AS n FROM m)
    SELECT CAST(n AS BIGINT) AS n, round(100 * (1 - s / (n * (n - 1) / 2.0)), 6) AS diversity FROM p, n""",
)
def _(t):
    fp = S.circular_fingerprint(t.nodes, t.edges)
    return S.internal_diversity(fp).select("n", F.round("diversity", 6).alias("diversity"))


@query(
    "variant_distances",
    f"SELECT label, {sql_r6('avg(d)')} AS mean, {sql_r6('stddev_pop(d)')} AS std, {sql_r6('min(d)')} AS min, {sql_r6('max(d)')} AS max FROM (SELECT a.label, 1 - {_cos(1, 64)} AS d {_PAIRS}) GROUP BY label",
)
def _(t):
    d = _neighbours(t).select("label", S.cosine_distance("v", "w").alias("d"))
    return S.variant_distances(d, "label", "d").select("label", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "mean_pairwise_tanimoto",
    f"WITH {_WORDS}, n AS (SELECT count(*) AS n FROM sz) SELECT n.n, round(sum(co.c / (a.k + b.k - co.c)) / (n.n * (n.n - 1) / 2.0), 6) AS mean FROM n, co JOIN sz a ON a.doc_id = co.x JOIN sz b ON b.doc_id = co.y GROUP BY n.n",
)
def _(t):
    return S.mean_pairwise_tanimoto(word_bits(t)).select("n", F.round("mean", 6).alias("mean"))
