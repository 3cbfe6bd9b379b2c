"""Queries over statistics, sampling and model-ready tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from braidvec.catalog.common import long_rows, r6
from braidvec.catalog.features import _SIZE_SQL
from braidvec.catalog.metrics import _rounded
from braidvec.catalog.registry import query
from braidvec.catalog.similarity import vectors
from braidvec.catalog.sqltext import WITH, r6 as sql_r6
from braidvec.operators import stats as T

_ST = "st AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, greatest(stddev_samp(embedding[i]::DOUBLE), 1e-8) AS s FROM embeddings, range(1, 65) r(i) GROUP BY ALL)"


@query("vector_stats", f"WITH {_ST} SELECT CAST(i - 1 AS INTEGER) AS d, {sql_r6('m')} AS mean, {sql_r6('s')} AS std FROM st")
def _(t):
    return _rounded(T.vector_stats(vectors(t), "v"))


@query("standardize", f"WITH {_ST} SELECT e.vec_id, CAST(i - 1 AS BIGINT) AS d, {sql_r6('(e.embedding[i]::DOUBLE - m) / s')} AS v FROM embeddings e, st")
def _(t):
    v = vectors(t)
    mean, std = T.stats_arrays(T.vector_stats(v, "v"))
    return long_rows(v.withColumn("z", T.standardize("v", mean, std)), ["vec_id"], "z")


@query("destandardize", f"SELECT vec_id, CAST(i - 1 AS BIGINT) AS d, {sql_r6('embedding[i]::DOUBLE')} AS v FROM embeddings, range(1, 65) r(i)")
def _(t):
    v = vectors(t)
    mean, std = T.stats_arrays(T.vector_stats(v, "v"))
    z = v.withColumn("z", T.standardize("v", mean, std))
    return long_rows(z.withColumn("back", T.destandardize("z", mean, std)), ["vec_id"], "back")


def _components(k: int) -> str:
    """CTEs up to ``comp`` (i, e, l): the k leading eigenvectors and eigenvalues of the covariance, each with its largest entry
    positive. A matrix squared 24 times has the leading eigenvector in every column; it is then taken out of the covariance."""
    return f"""z AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(v[i]) AS m FROM z, range(1, 65) r(i) GROUP BY ALL)),
    x AS MATERIALIZED (SELECT vec_id, v, list_transform(v, lambda a, i: a - mu[i]) AS c FROM z, mu),
    cv AS MATERIALIZED (SELECT i.i, j.j, sum(c[i.i] * c[j.j]) / (SELECT count(*) - 1 FROM z) AS s FROM x, range(1, 65) i(i), range(1, 65) j(j) GROUP BY ALL),
    co AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(s ORDER BY j) AS r FROM cv GROUP BY i)),
    it AS (SELECT 0 AS k, c, c AS m, []::DOUBLE[][] AS found FROM co
      UNION ALL SELECT k + 1, CASE WHEN e IS NULL THEN c ELSE rest END, CASE WHEN e IS NULL THEN list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q) / t)) ELSE rest END,
        CASE WHEN e IS NULL THEN found ELSE list_append(found, list_append(e, l)) END
      FROM (SELECT *, list_transform(c, lambda r, i: list_transform(r, lambda a, j: a - l * e[i] * e[j])) AS rest
        FROM (SELECT *, list_sum(list_transform(e, lambda a, i: a * list_dot_product(c[i], e))) AS l
          FROM (SELECT *, CASE WHEN k % 25 = 24 THEN list_transform(top, lambda a: a / sqrt(list_dot_product(top, top)) * CASE WHEN list_max(top) >= -list_min(top) THEN 1 ELSE -1 END) END AS e
            FROM (SELECT *, m[list_position(d, list_max(d))] AS top, list_dot_product(d, d) AS t FROM (SELECT *, list_transform(m, lambda r, i: r[i]) AS d FROM it WHERE k < 25 * {k})))))),
    comp AS MATERIALIZED (SELECT i, found[i][1:64] AS e, found[i][65] AS l FROM it, range(1, {k + 1}) r(i) WHERE k = 25 * {k})"""


_RATIO = f"WITH RECURSIVE {_components(8)} SELECT i - 1 AS component, {sql_r6('l / (SELECT sum(s) FROM cv WHERE i = j)')} AS ratio FROM comp"


@query("pca_fit", _RATIO)
def _(t):
    pca = T.pca_fit(vectors(t), "v", 8)
    rows = [(i, float(pca.ratio[i])) for i in range(8)]
    return _rounded(t.spark.createDataFrame(rows, "component long, ratio double"))


@query("pca_fit_wide", _RATIO)
def _(t):
    """The same components without a matrix of all positions."""
    from braidvec.operators.wide import pca_fit_wide

    pca = pca_fit_wide(vectors(t), "v", 8)
    return _rounded(t.spark.createDataFrame([(i, float(pca.ratio[i])) for i in range(8)], "component long, ratio double"))


@query("pca_project", f"WITH RECURSIVE {_components(8)} SELECT vec_id, i - 1 AS d, {sql_r6('list_dot_product(c, e)')} AS v FROM x, comp")
def _(t):
    v = vectors(t)
    return long_rows(T.pca_project(v, "v", T.pca_fit(v, "v", 8)), ["vec_id"], "projected")


# With all components kept, projection and back is the identity.
@query("pca_inverse", f"SELECT vec_id, CAST(i - 1 AS BIGINT) AS d, {sql_r6('embedding[i]::DOUBLE')} AS v FROM embeddings, range(1, 65) r(i)")
def _(t):
    v = vectors(t)
    pca = T.pca_fit(v, "v", 64)
    return long_rows(T.pca_inverse(T.pca_project(v, "v", pca), "projected", pca), ["vec_id"], "restored")


@query(
    "pca_roundtrip",
    f"""WITH RECURSIVE {_components(32)}, p AS (SELECT vec_id, v, j.j, sum(list_dot_product(c, e) * e[j.j]) + any_value(mu[j.j]) AS b FROM x, mu, comp, range(1, 65) j(j) GROUP BY vec_id, v, j.j),
    ds AS (SELECT 1 - list_cosine_similarity(v, list(b ORDER BY j)) AS d FROM p GROUP BY vec_id, v)
    SELECT {sql_r6('avg(d)')} AS mean, {sql_r6('max(d)')} AS max, {sql_r6('list_sort(list(d))[(count(*) + 1) // 2]')} AS median FROM ds""",
)
def _(t):
    v = vectors(t)
    return _rounded(T.pca_roundtrip(v, "v", T.pca_fit(v, "v", 32)))


@query(
    "edge_marginals",
    f"{WITH}, c AS (SELECT bond, count(*) AS c FROM bonds GROUP BY ALL UNION ALL SELECT 0, (SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM nodes GROUP BY graph_id)) - (SELECT count(*) FROM bonds)) SELECT bond, round(c / sum(c) OVER (), 6) AS p FROM c",
)
def _(t):
    return _rounded(T.edge_marginals(t.nodes, t.bonds))


@query("size_edge_marginals", f"{WITH}, {_SIZE_SQL} SELECT size, CAST(bond AS INTEGER) AS bond, round(p, 6) AS p FROM marg")
def _(t):
    return _rounded(T.size_edge_marginals(t.nodes, t.bonds, 12))


_HIST = "sz AS (SELECT count(*) AS size FROM nodes GROUP BY graph_id), hist AS (SELECT r.size, count(sz.size) AS cnt FROM range(100) r(size) LEFT JOIN sz ON sz.size = r.size WHERE r.size <= (SELECT max(size) FROM sz) GROUP BY ALL)"


@query("size_histogram", f"{WITH}, {_HIST} SELECT size, cnt FROM hist")
def _(t):
    return T.size_histogram(t.nodes)


@query(
    "sample_sizes",
    f"""{WITH}, {_HIST}, cum AS (SELECT size, sum(cnt) OVER (ORDER BY size) AS hi, sum(cnt) OVER (ORDER BY size) - cnt AS lo FROM hist),
    dr AS (SELECT o_orderkey AS draw_id, (CAST('0x' || substr(md5(concat_ws('|', '3', o_orderkey)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 * (SELECT sum(cnt) FROM hist) AS u FROM orders)
    SELECT draw_id, CAST(size AS INTEGER) AS size FROM dr JOIN cum ON u >= lo AND u < hi""",
)
def _(t):
    draws = t.read("orders").select(F.col("o_orderkey").alias("draw_id"))
    return T.sample_sizes(draws, T.size_histogram(t.nodes), 3)


_ORD = "o AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY md5(concat_ws('|', '17', p_partkey)), p_partkey) AS rn, count(*) OVER () AS n FROM part)"


@query("sample_n", f"WITH {_ORD} SELECT p_partkey FROM o WHERE rn <= 77")
def _(t):
    return T.sample_n(t.read("part"), "p_partkey", 77, 17).select("p_partkey")


@query("random_split", f"WITH {_ORD} SELECT p_partkey, CASE WHEN rn <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM o")
def _(t):
    return T.random_split(t.read("part"), "p_partkey", 17).select("p_partkey", "split")


@query(
    "stratified_sample",
    """WITH q AS (SELECT quantile_cont(p_size, [0.25, 0.5, 0.75]) AS e FROM part), s AS (SELECT p_partkey, p_size, CASE WHEN p_size > e[1] THEN 1 ELSE 0 END + CASE WHEN p_size > e[2] AND e[2] > e[1] THEN 1 ELSE 0 END + CASE WHEN p_size > e[3] AND e[3] > e[2] THEN 1 ELSE 0 END AS stratum FROM part, q),
    c AS (SELECT stratum, count(*) AS c, 90.0 * count(*) / (SELECT count(*) FROM part) AS x FROM s GROUP BY ALL), f AS (SELECT *, floor(x) AS base, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS r, 90 - sum(floor(x)) OVER () AS spare FROM c),
    k AS (SELECT stratum, base + CASE WHEN r <= spare THEN 1 ELSE 0 END AS k FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '17', p_partkey)), p_partkey) AS rn FROM s)
    SELECT p_partkey, o.stratum FROM o JOIN k ON k.stratum = o.stratum AND o.rn <= k.k""",
)
def _(t):
    return T.stratified_sample(t.read("part"), "p_partkey", "p_size", 90, 17).select("p_partkey", "stratum")


_CLEAN = "CASE WHEN length(trim(text)) >= 200 THEN md5(lower(trim(text))) END"


def _cleaned():
    return F.when(F.length(F.trim("text")) >= 200, F.md5(F.lower(F.trim("text"))))


@query("clean_and_dedup", f"SELECT {_CLEAN} AS clean_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE {_CLEAN} IS NOT NULL GROUP BY 1")
def _(t):
    docs = t.read("documents").select("doc_id", "text", "source")
    return T.clean_and_dedup(docs, _cleaned(), "doc_id").select("clean_key", "doc_id", "source")


@query("cleaning_report", f"SELECT count(*) AS raw, count(*) FILTER (k IS NULL) AS failed, count(DISTINCT k) AS kept, count(k) - count(DISTINCT k) AS duplicates FROM (SELECT {_CLEAN} AS k FROM documents)")
def _(t):
    return T.cleaning_report(t.read("documents"), _cleaned())


def _halves(t):
    return vectors(t).select("vec_id", "label", F.slice("v", 1, 16).alias("x"), F.slice("v", 33, 4).alias("y"))


# One input column here, so that SQL has the same fit; several inputs are compared with numpy in the tests.
_FIT = """fit AS (SELECT i, regr_slope(embedding[i]::DOUBLE, embedding[1]::DOUBLE) AS w, regr_intercept(embedding[i]::DOUBLE, embedding[1]::DOUBLE) AS b FROM embeddings, range(33, 37) r(i) GROUP BY ALL),
pred AS (SELECT vec_id, i, b + w * embedding[1]::DOUBLE AS p, embedding[i]::DOUBLE AS y FROM embeddings, fit)"""


@query("fit_linear_map", f"WITH {_FIT} SELECT vec_id, CAST(i - 33 AS BIGINT) AS d, {sql_r6('p')} AS v, (SELECT {sql_r6('avg((p - y) ** 2)')} FROM pred) AS mse FROM pred")
def _(t):
    v = vectors(t).select("vec_id", F.slice("v", 1, 1).alias("x"), F.slice("v", 33, 4).alias("y"))
    model = T.fit_linear_map(v, "x", "y")
    return long_rows(T.apply_linear_map(v, "x", model), ["vec_id"], "predicted").withColumn("mse", F.round(F.lit(model.mse), 6))


_I, _J = "x.embedding[1:32]::DOUBLE[]", "y.embedding[33:64]::DOUBLE[]"


@query(
    "info_nce",
    f"""WITH l AS (SELECT x.vec_id // 50 AS batch, x.vec_id AS i, y.vec_id AS j, list_cosine_similarity({_I}, {_J}) / 0.5 AS l FROM embeddings x JOIN embeddings y ON x.vec_id // 50 = y.vec_id // 50),
    r AS (SELECT batch, i, ln(sum(exp(l))) - max(l) FILTER (i = j) AS a FROM l GROUP BY ALL), c AS (SELECT batch, j, ln(sum(exp(l))) - max(l) FILTER (i = j) AS a FROM l GROUP BY ALL)
    SELECT r.batch, count(*) AS n, {sql_r6('(avg(r.a) + avg(c.a)) / 2')} AS loss FROM r JOIN c ON r.batch = c.batch AND r.i = c.j GROUP BY ALL""",
)
def _(t):
    v = vectors(t).select(F.floor(F.col("vec_id") / 50).cast("long").alias("batch"), F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return _rounded(T.info_nce(v, "batch", "a", "b", 0.5))


@query(
    "info_nce_whole",
    f"""WITH l AS (SELECT x.vec_id AS i, y.vec_id AS j, list_cosine_similarity({_I}, {_J}) / 0.5 AS l FROM embeddings x, embeddings y),
    r AS (SELECT i, ln(sum(exp(l))) - max(l) FILTER (i = j) AS a FROM l GROUP BY ALL), c AS (SELECT j, ln(sum(exp(l))) - max(l) FILTER (i = j) AS a FROM l GROUP BY ALL)
    SELECT CAST(0 AS BIGINT) AS batch, count(*) AS n, {sql_r6('(avg(r.a) + avg(c.a)) / 2')} AS loss FROM r JOIN c ON r.i = c.j""",
)
def _(t):
    """All vectors as one batch, scored on the grid."""
    v = vectors(t).select(F.lit(0).cast("long").alias("batch"), F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return _rounded(T.info_nce(v, "batch", "a", "b", 0.5, limit=64, group_rows=128))


@query(
    "translation_loss",
    f"""WITH r AS (SELECT 1 - list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS c, list_distance(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) ** 2 AS s FROM embeddings)
    SELECT {sql_r6('avg(c)')} AS cosine_loss, {sql_r6('sum(s) / (32 * count(*))')} AS mse_loss, {sql_r6('0.7 * avg(c) + 0.3 * sum(s) / (32 * count(*))')} AS loss FROM r""",
)
def _(t):
    v = vectors(t).select(F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return _rounded(T.translation_loss(v, "a", "b", 0.7, 0.3))


_NLL = f"WITH {_ST}, n AS (SELECT e.vec_id, 0.5 * sum(((e.embedding[i]::DOUBLE - m) / s) ** 2) + 32 * ln(2 * pi()) + sum(ln(s)) AS nll FROM embeddings e, st GROUP BY ALL)"


def _nll(t):
    v = vectors(t)
    mean, std = T.stats_arrays(T.vector_stats(v, "v"))
    return v.select("vec_id", T.gaussian_nll("v", mean, std).alias("nll"))


@query("gaussian_nll", f"{_NLL} SELECT vec_id, {sql_r6('nll')} AS nll FROM n")
def _(t):
    return _rounded(_nll(t))


@query("bits_per_dim", f"{_NLL} SELECT {sql_r6(f'avg(nll) / (64 * {math.log(2)!r})')} AS bpd FROM n")
def _(t):
    return _nll(t).agg(r6(T.bits_per_dim(F.avg("nll"), 64)).alias("bpd"))


@query("property_regression", f"WITH {_FIT} SELECT {sql_r6('avg(abs(p - y))')} AS mae, {sql_r6('sqrt(avg((p - y) ** 2))')} AS rmse, {sql_r6('1 - sum((p - y) ** 2) / (var_pop(y) * count(*))')} AS r2 FROM pred WHERE i = 33")
def _(t):
    v = vectors(t).select("vec_id", F.slice("v", 1, 1).alias("x"), F.col("v")[32].alias("y"))
    return _rounded(T.property_regression(v, "x", "y")[1])


def _least_squares(inputs: int, outputs: int) -> str:
    """CTE ``pred`` (vec_id, d, p, y): the first entries of a vector and a constant as inputs, the last ones as outputs. The normal
    equations of the whole table are solved by elimination, one column a step."""
    n = inputs + 1
    return f"""z AS MATERIALIZED (SELECT vec_id, [1.0::DOUBLE] || embedding[1:{inputs}]::DOUBLE[] || embedding[{65 - outputs}:64]::DOUBLE[] AS v FROM embeddings),
    cells AS (SELECT i.i, j.j, sum(v[i.i] * v[j.j]) AS s FROM z, range(1, {n + 1}) i(i), range(1, {n + outputs + 1}) j(j) GROUP BY ALL),
    grid AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cells GROUP BY i)),
    el AS (SELECT 1 AS k, m FROM grid UNION ALL SELECT k + 1, list_transform(m, lambda r, a: CASE WHEN a = k THEN list_transform(r, lambda x: x / m[k][k])
      ELSE list_transform(r, lambda x, b: x - r[k] * m[k][b] / m[k][k]) END) FROM el WHERE k <= {n}),
    sol AS (SELECT m FROM el WHERE k = {n + 1}),
    pred AS (SELECT vec_id, d.d, list_sum(list_transform(v[1:{n}], lambda x, a: x * m[a][{n} + 1 + d.d])) AS p, v[{n} + 1 + d.d] AS y FROM z, sol, range({outputs}) d(d))"""


@query("fit_linear_map_whole", f"WITH RECURSIVE {_least_squares(60, 4)} SELECT vec_id, d, {sql_r6('p')} AS v, (SELECT {sql_r6('avg((p - y) ** 2)')} FROM pred) AS mse FROM pred")
def _(t):
    """Sixty input columns and four outputs."""
    v = vectors(t).select("vec_id", F.slice("v", 1, 60).alias("x"), F.slice("v", 61, 4).alias("y"))
    model = T.fit_linear_map(v, "x", "y")
    return long_rows(T.apply_linear_map(v, "x", model), ["vec_id"], "predicted").withColumn("mse", F.round(F.lit(model.mse), 6))


@query("property_regression_whole", f"WITH RECURSIVE {_least_squares(63, 1)} SELECT {sql_r6('avg(abs(p - y))')} AS mae, {sql_r6('sqrt(avg((p - y) ** 2))')} AS rmse, {sql_r6('1 - sum((p - y) ** 2) / (var_pop(y) * count(*))')} AS r2 FROM pred")
def _(t):
    v = vectors(t).select("vec_id", F.slice("v", 1, 63).alias("x"), F.col("v")[63].alias("y"))
    return _rounded(T.property_regression(v, "x", "y")[1])


@query("regression_metrics", "SELECT round(avg(abs(l_quantity * 1500 - l_extendedprice)), 6) AS mae, round(sqrt(avg((l_quantity * 1500 - l_extendedprice) ** 2)), 6) AS rmse, round(1 - sum((l_quantity * 1500 - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def _(t):
    rows = t.read("lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return _rounded(T.regression_metrics(rows, "guess", "l_extendedprice"))


@query(
    "moving_average",
    "SELECT event_id, user_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 5 THEN value ELSE avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS smooth FROM events WHERE NOT isnan(value)",
)
def _(t):
    events = t.read("events").select("event_id", "user_id", "ts", "value")
    out = T.moving_average(events, "user_id", ["ts", "event_id"], "value", 5)
    return out.select("event_id", "user_id", F.round("smooth", 6).alias("smooth"))
