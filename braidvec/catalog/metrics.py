"""Queries over the evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.common import BINS, r6, text
from braidvec.catalog.decoding import _COMPARED, compare
from braidvec.catalog.registry import query
from braidvec.catalog.relations import RINGS_SQL
from braidvec.catalog.similarity import vectors
from braidvec.catalog.sqltext import WITH, r6 as sql_r6
from braidvec.operators import encode as E
from braidvec.operators import graphs as G
from braidvec.operators import metrics as M

_KEYS = """k AS (SELECT d.doc_id, d.source, md5(lower(trim(d.text))) AS key, coalesce(l.quality, 0) = 1 AS valid, coalesce(l.toxic, 0) = 0 AS final, d.n_chars::DOUBLE AS value FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT * FROM k WHERE CAST(substr(source, 4) AS INTEGER) % 3 <> 0), r AS (SELECT DISTINCT key FROM k WHERE CAST(substr(source, 4) AS INTEGER) % 3 = 0)"""


def doc_keys(t):
    """Structural key, validity and a property of each document; every third source is the reference."""
    docs = t.read("documents").join(t.read("labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("key"), (F.coalesce("quality", F.lit(0)) == 1).alias("valid"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("final"), F.col("n_chars").cast("double").alias("value"),
    )


def _sides(t):
    k = doc_keys(t)
    third = F.substring("source", 4, 10).cast("int") % 3
    return k.filter(third != 0), k.filter(third == 0)


def _rounded(df, keep=()):
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns])


@query(
    "generation_metrics",
    f"""WITH {_KEYS}, a AS (SELECT count(*) AS n, count(*) FILTER (valid) AS v, count(DISTINCT key) FILTER (valid) AS u, count(DISTINCT key) FILTER (valid AND key NOT IN (SELECT key FROM r)) AS w FROM s)
    SELECT n AS n_samples, v AS n_valid, round(100.0 * v / n, 6) AS validity, round(100.0 * u / v, 6) AS uniqueness, round(100.0 * w / v, 6) AS novelty, round(100.0 * w / n, 6) AS nuv FROM a""",
)
def _(t):
    return _rounded(M.generation_metrics(*_sides(t)))


@query(
    "optimization_metrics",
    f"""WITH {_KEYS}, a AS (SELECT count(*) AS n, count(*) FILTER (valid) AS v, count(DISTINCT key) FILTER (valid) AS u, count(DISTINCT key) FILTER (valid AND key NOT IN (SELECT key FROM r)) AS w FROM s)
    SELECT v AS n_valid, u AS n_unique, w AS n_novel, round(1.0 * v / n, 6) AS validity, round(1.0 * u / v, 6) AS uniqueness, round(1.0 * w / u, 6) AS novelty FROM a""",
)
def _(t):
    return _rounded(M.optimization_metrics(*_sides(t)))


@query(
    "conditional_metrics",
    f"""WITH {_KEYS}, e AS (SELECT *, abs(value - 1500) AS err FROM s), a AS (SELECT count(*) AS n, count(*) FILTER (final) AS f, count(*) FILTER (valid) AS v, avg(err) FILTER (valid) AS mae, sqrt(avg(err * err) FILTER (valid)) AS rmse,
      count(*) FILTER (valid AND err <= 600) AS h, count(*) FILTER (valid AND err <= 600 AND final) AS fh, count(DISTINCT key) FILTER (valid) AS u, count(DISTINCT key) FILTER (valid AND key NOT IN (SELECT key FROM r)) AS w,
      count(DISTINCT key) FILTER (valid AND err <= 600) AS hu, count(DISTINCT key) FILTER (valid AND err <= 600 AND key NOT IN (SELECT key FROM r)) AS hw FROM e)
    SELECT n::INTEGER AS total_samples, round(100.0 * v / n, 6) AS validity_pct, round(100.0 * f / n, 6) AS final_pct, v AS n_valid, v AS n_valid_non_nan, round(mae, 6) AS mae_to_target, round(rmse, 6) AS rmse_to_target,
      round(100.0 * h / v, 6) AS success_at_eps_pct, round(100.0 * fh / v, 6) AS final_success_at_eps_pct, round(100.0 * u / v, 6) AS uniqueness_pct, round(100.0 * w / v, 6) AS novelty_pct,
      h AS n_hits, CASE WHEN h > 0 THEN round(100.0 * hu / h, 6) ELSE 0.0 END AS uniqueness_hits_pct, CASE WHEN h > 0 THEN round(100.0 * hw / h, 6) ELSE 0.0 END AS novelty_hits_pct FROM a""",
)
def _(t):
    return _rounded(M.conditional_metrics(*_sides(t), target=1500.0, eps=600.0))


@query(
    "property_stats",
    "SELECT p_type, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("p_retailprice", "p_size")) + " FROM part GROUP BY ALL",
)
def _(t):
    return _rounded(M.property_stats(t.read("part"), ["p_retailprice", "p_size"], ["p_type"]))


_GEN, _REF = "p_size % 2 = 0", "p_size % 2 = 1"


def _halves(t):
    return t.read("part").filter(_GEN), t.read("part").filter(_REF)


@query(
    "kl_divergence",
    f"""WITH b AS (SELECT min(p_retailprice) - (max(p_retailprice) - min(p_retailprice)) * 0.01 AS lo, (max(p_retailprice) - min(p_retailprice) + 2 * ((max(p_retailprice) - min(p_retailprice)) * 0.01)) / 50 AS w FROM part),
    h AS (SELECT least(floor((p_retailprice - lo) / w), 49) AS bin, count(*) FILTER ({_GEN}) AS g, count(*) FILTER ({_REF}) AS r FROM part, b GROUP BY ALL),
    d AS (SELECT coalesce(g, 0) / ((SELECT sum(g) FROM h) * (SELECT w FROM b)) + 1e-10 AS g, coalesce(r, 0) / ((SELECT sum(r) FROM h) * (SELECT w FROM b)) + 1e-10 AS r FROM range(50) x(bin) LEFT JOIN h USING (bin)),
    p AS (SELECT g / (SELECT sum(g) FROM d) AS g, r / (SELECT sum(r) FROM d) AS r FROM d) SELECT {sql_r6('sum(g * ln(g / r))')} AS kl FROM p""",
)
def _(t):
    return _rounded(M.kl_divergence(*_halves(t), "p_retailprice"))


def _by_rows(cells: str) -> str:
    """A table (i, j, s) as one list of rows."""
    return f"(SELECT list(r ORDER BY i) FROM (SELECT i, list(s ORDER BY j) AS r FROM {cells} GROUP BY i))"


_TURN = "list_transform({m}[1], lambda zero, j: list_transform({m}, lambda r: r[j]))"


def _times(a: str, b: str) -> str:
    return f"list_transform({a}, lambda r: list_transform({_TURN.format(m=b)}, lambda q: list_dot_product(r, q)))"


# The root of the product of both covariances by the coupled iteration Y' = Y·T, Z' = T·Z with T = (3I − Z·Y) / 2.
@query(
    "frechet_distance",
    f"""WITH RECURSIVE z AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v, label < 5 AS g FROM embeddings WHERE label IS NOT NULL),
    mu AS MATERIALIZED (SELECT g, i, avg(v[i]) AS m, count(*) AS n FROM z, range(1, 65) r(i) GROUP BY ALL),
    cv AS MATERIALIZED (SELECT z.g, a.i, b.i AS j, sum((v[a.i] - a.m) * (v[b.i] - b.m)) / (any_value(a.n) - 1) AS s FROM z JOIN mu a ON a.g = z.g JOIN mu b ON b.g = z.g GROUP BY ALL),
    pr AS (SELECT {_times("a", "b")} AS m FROM (SELECT {_by_rows("(SELECT * FROM cv WHERE g)")} AS a, {_by_rows("(SELECT * FROM cv WHERE NOT g)")} AS b)),
    sc AS (SELECT m, sqrt(list_sum(list_transform(m, lambda r: list_dot_product(r, r)))) AS f FROM pr),
    it AS (SELECT 0 AS k, f, list_transform(m, lambda r: list_transform(r, lambda a: a / f)) AS y, list_transform(m, lambda r, i: list_transform(r, lambda a, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END)) AS z FROM sc
      UNION ALL SELECT k + 1, f, {_times("y", "t")}, {_times("t", "z")}
      FROM (SELECT *, list_transform({_times("z", "y")}, lambda r, i: list_transform(r, lambda a, j: (CASE WHEN i = j THEN 3 ELSE 0 END - a) / 2)) AS t FROM it WHERE k < 40))
    SELECT {sql_r6("(SELECT sum((a.m - b.m) ** 2) FROM mu a JOIN mu b ON a.i = b.i AND a.g AND NOT b.g) + (SELECT sum(s) FROM cv WHERE i = j) - 2 * sqrt(f) * list_sum(list_transform(y, lambda r, i: r[i]))")} AS distance FROM it WHERE k = 40""",
)
def _(t):
    v = vectors(t)
    value = M.frechet_distance(v.filter("label < 5"), v.filter("label >= 5"), "v")
    return t.spark.range(1).select(F.round(F.lit(value), 6).alias("distance"))


@query("top_k_mean", "SELECT round(avg(p_retailprice), 6) AS top_mean FROM (SELECT p_retailprice FROM part ORDER BY 1 DESC LIMIT 50)")
def _(t):
    return _rounded(M.top_k_mean(t.read("part"), "p_retailprice", 50))


@query(
    "composite_score",
    """WITH p AS (SELECT p_type, avg((p_size > 20)::INTEGER) AS a, count(DISTINCT p_name) / count(*) AS b, avg((p_size > 49)::INTEGER) AS c, max(p_retailprice) / 2000 AS d, CASE WHEN count(*) >= 30 THEN avg(p_retailprice) / 2000 END AS e FROM part GROUP BY ALL)
    SELECT p_type, CASE WHEN e IS NULL THEN NULL WHEN least(a, b, c, d, e) <= 0 THEN 0.0 ELSE round(exp((ln(greatest(a, 1e-300)) + ln(b) + ln(greatest(c, 1e-300)) + ln(d) + ln(e)) / 5), 6) END AS score FROM p""",
)
def _(t):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    parts = t.read("part").groupBy("p_type").agg(
        share(F.col("p_size") > 20).alias("a"), (F.countDistinct("p_name") / F.count("*")).alias("b"), share(F.col("p_size") > 49).alias("c"),
        (F.max("p_retailprice") / 2000).alias("d"), F.when(F.count("*") >= 30, F.avg("p_retailprice") / 2000).alias("e"),
    )
    return parts.select("p_type", F.round(M.composite_score([F.col(c) for c in "abcde"]), 6).alias("score"))


@query("target_error", "SELECT p_type, round(avg(abs(p_retailprice - 950.4)), 6) AS mae, round(avg((abs(p_retailprice - 950.4) < 0.5)::INTEGER), 6) AS within_0_5, round(avg((abs(p_retailprice - 950.4) < 1.0)::INTEGER), 6) AS within_1_0 FROM part GROUP BY ALL")
def _(t):
    return _rounded(M.target_error(t.read("part"), "p_retailprice", 950.4, ["p_type"]))


_IOU_PE = f"{WITH}, pe AS (SELECT e.graph_id, e.src, a.idx AS a, b.idx AS b FROM edges e JOIN idx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN idx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"


@query(
    "edge_iou",
    f"""{_IOU_PE}, x AS (SELECT graph_id, a, b, count(*) AS c FROM pe GROUP BY ALL), y AS (SELECT graph_id, a, b, count(*) + 1 AS c FROM pe WHERE src < 2 GROUP BY ALL)
    SELECT coalesce(x.graph_id, y.graph_id) AS graph_id, round(sum(least(coalesce(x.c, 0), coalesce(y.c, 0))) / sum(greatest(coalesce(x.c, 0), coalesce(y.c, 0))), 6) AS iou FROM x FULL JOIN y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b = y.b GROUP BY ALL""",
)
def _(t):
    full = E.edge_pair_counts(t.nodes, t.edges, BINS)
    part = E.edge_pair_counts(t.nodes, t.edges.filter("src < 2"), BINS).withColumn("cnt", F.col("cnt") + 1)
    return _rounded(M.edge_iou(full, part))


@query("accuracy_by_size", f"{_COMPARED}, m AS (SELECT graph_id, sum(abs(x - y)) = 0 AS ok, sum(y) AS n FROM both_c GROUP BY ALL) SELECT CAST(n AS BIGINT) AS num_nodes, round(avg(ok::INTEGER), 6) AS hit_rate, count(*) AS count, round(avg(ok::INTEGER) * 100, 6) AS hit_rate_pct FROM m GROUP BY ALL")
def _(t):
    return _rounded(M.accuracy_by_size(compare(t).withColumnRenamed("truth_total", "num_nodes"), "num_nodes", "exact_match"))


@query(
    "retrieval_summary",
    """SELECT round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std,
    round(100 * avg((l_returnflag = 'A')::INTEGER), 6) AS l_returnflag_A_pct, round(100 * avg((l_returnflag = 'N')::INTEGER), 6) AS l_returnflag_N_pct, round(100 * avg((l_returnflag = 'R')::INTEGER), 6) AS l_returnflag_R_pct,
    count(*) FILTER (l_quantity = 1 AND l_linestatus <> 'F') AS max_sim_non_hits FROM lineitem""",
)
def _(t):
    rows = t.read("lineitem").withColumn("_match", F.col("l_linestatus") == "F")
    return _rounded(M.retrieval_summary(rows, ["l_quantity", "l_discount"], "l_returnflag", ["A", "N", "R"], "l_quantity", "_match"))


@query(
    "category_frequencies",
    f"WITH a AS (SELECT p_brand, count(*) AS c FROM part WHERE {_GEN} AND p_brand <> 'Brand#3' GROUP BY ALL), b AS (SELECT p_brand, count(*) AS c FROM part WHERE {_REF} AND p_brand <> 'Brand#5' GROUP BY ALL) "
    "SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, round(coalesce(a.c, 0) / (SELECT sum(c) FROM a), 6) AS gen_freq, round(coalesce(b.c, 0) / (SELECT sum(c) FROM b), 6) AS ref_freq FROM a FULL JOIN b ON a.p_brand = b.p_brand",
)
def _(t):
    g, r = _halves(t)
    return _rounded(M.category_frequencies(g.filter("p_brand <> 'Brand#3'"), r.filter("p_brand <> 'Brand#5'"), "p_brand"))


@query(
    "category_frequencies_whole",
    f"WITH a AS (SELECT p_brand, count(*) AS c FROM part WHERE {_GEN} GROUP BY ALL), b AS (SELECT p_brand, count(*) AS c FROM part WHERE {_REF} GROUP BY ALL) "
    "SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, round(coalesce(a.c, 0) / (SELECT sum(c) FROM a), 6) AS gen_freq, round(coalesce(b.c, 0) / (SELECT sum(c) FROM b), 6) AS ref_freq FROM a FULL JOIN b ON a.p_brand = b.p_brand",
)
def _(t):
    return _rounded(M.category_frequencies(*_halves(t), "p_brand"))


@query(
    "shared_histogram",
    f"""WITH b AS (SELECT min(p_retailprice) AS lo, least(30, greatest(10, CAST(trunc(max(p_retailprice) - min(p_retailprice)) AS INTEGER) + 1)) AS nb, max(p_retailprice) - min(p_retailprice) AS rg FROM part),
    h AS (SELECT least(floor((p_retailprice - lo) / (rg / nb)), nb - 1) AS bin, count(*) FILTER ({_GEN}) AS g, count(*) FILTER ({_REF}) AS r FROM part, b GROUP BY ALL)
    SELECT x.bin, round(lo + x.bin * (rg / nb), 6) AS lo, round(lo + (x.bin + 1) * (rg / nb), 6) AS hi, coalesce(g, 0) AS gen, coalesce(r, 0) AS ref FROM range(30) x(bin), b LEFT JOIN h ON h.bin = x.bin WHERE x.bin < nb""",
)
def _(t):
    return _rounded(M.shared_histogram(*_halves(t), "p_retailprice"))


@query(
    "shared_histogram_integer",
    f"SELECT x.bin, x.bin + lo - 0.5::DOUBLE AS lo, x.bin + lo + 0.5::DOUBLE AS hi, count(*) FILTER (p_size % 2 = 0) AS gen, count(*) FILTER (p_size % 2 = 1) AS ref FROM (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) b, range(100) x(bin) LEFT JOIN part ON p_size = x.bin + (SELECT min(p_size) FROM part) WHERE x.bin <= hi - lo GROUP BY ALL",
)
def _(t):
    return M.shared_histogram(*_halves(t), "p_size", integer=True)


_PROFILE = f"""{WITH}, {RINGS_SQL}, pr AS (
  SELECT 'atom' AS kind, f0::BIGINT AS value, count(*) AS cnt FROM nodes GROUP BY ALL UNION ALL SELECT 'bond', bond, count(*) FROM bonds WHERE src < dst GROUP BY ALL
  UNION ALL SELECT 'degree', degree, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT 'num_atoms', n, count(*) FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 'num_bonds', m, count(*) FROM (SELECT n.graph_id, count(e.src) AS m FROM (SELECT DISTINCT graph_id FROM nodes) n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.src < e.dst GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 'ring_size', size, count(*) FROM (SELECT DISTINCT graph_id, ring_id, size FROM rings) GROUP BY ALL
  UNION ALL SELECT 'num_rings', k, count(*) FROM (SELECT n.graph_id, count(t.ring_id) AS k FROM (SELECT DISTINCT graph_id FROM nodes) n LEFT JOIN (SELECT DISTINCT graph_id, ring_id FROM rings) t ON t.graph_id = n.graph_id GROUP BY ALL) GROUP BY ALL)"""


def _profile(t):
    return M.structure_profile(t.nodes, t.bonds, G.short_cycles(t.edges, 6))


@query("structure_profile", f"{_PROFILE} SELECT * FROM pr")
def _(t):
    return _profile(t)


@query(
    "count_summary",
    f"{_PROFILE}, x AS (SELECT kind, value, unnest(range(cnt)) AS u FROM pr) SELECT kind, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, median(value)::DOUBLE AS median FROM x GROUP BY ALL",
)
def _(t):
    return _rounded(M.count_summary(_profile(t)))


@query("sim_by_flag", f"WITH {_KEYS} SELECT round(coalesce(avg(value) FILTER (final), 0), 6) AS final_sim_mean, round(coalesce(stddev_pop(value) FILTER (final), 0), 6) AS final_sim_std, round(coalesce(avg(value) FILTER (NOT final), 0), 6) AS nonfinal_sim_mean, round(coalesce(stddev_pop(value) FILTER (NOT final), 0), 6) AS nonfinal_sim_std FROM k")
def _(t):
    return _rounded(M.sim_by_flag(doc_keys(t), "value", "final"))


_REASON = "CASE WHEN n < 3 THEN 'too_small' WHEN n > 8 THEN 'too_large' ELSE 'valid' END"


@query(
    "rejection_report",
    f"{WITH}, s AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), c AS (SELECT {_REASON} AS reason, count(*) AS cnt FROM s GROUP BY ALL) SELECT reason, cnt, CAST(sum(cnt) OVER () AS BIGINT) AS attempts, round((SELECT cnt FROM c WHERE reason = 'valid') / sum(cnt) OVER (), 6) AS validity_rate FROM c",
)
def _(t):
    sizes = t.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    return _rounded(M.rejection_report(sizes.withColumn("reason", F.expr(_REASON)), "reason"))


@query("similarity_quantiles", "SELECT round(avg(s), 6) AS mean, quantile_disc(s, 0.5) AS median, min(s) AS min, max(s) AS max, round(100 * avg((s > 0.9)::INTEGER), 6) AS pct_above_090, round(100 * avg((s > 0.95)::INTEGER), 6) AS pct_above_095, round(100 * avg((s > 0.99)::INTEGER), 6) AS pct_above_099 FROM (SELECT (l_quantity - 1) / 49.0 AS s FROM lineitem)")
def _(t):
    out = M.similarity_quantiles(t.read("lineitem").select(((F.col("l_quantity") - 1) / 49.0).alias("s")), "s")
    return _rounded(out, keep=("median", "min", "max"))


_PER_DIM = "SELECT i AS d, avg(embedding[i]::DOUBLE) AS m, stddev_samp(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) r(i) WHERE {} GROUP BY ALL"


@query(
    "distribution_match",
    f"""WITH g AS ({_PER_DIM.format('label < 5')}), r AS ({_PER_DIM.format('label >= 5')}), b AS (SELECT g.m AS gm, g.s AS gs, r.m AS rm, r.s AS rs FROM g JOIN r USING (d))
    SELECT {sql_r6('avg(abs(gm - rm))')} AS mean_mae, {sql_r6('avg(abs(gs - rs))')} AS std_mae, {sql_r6('1 - sum((gm - rm) ** 2) / greatest(var_pop(rm) * count(*), 1e-8)')} AS mean_r2, {sql_r6('1 - sum((gs - rs) ** 2) / greatest(var_pop(rs) * count(*), 1e-8)')} AS std_r2,
    {sql_r6('sum(gm * rm) / (greatest(sqrt(sum(gm * gm)), 1e-8) * greatest(sqrt(sum(rm * rm)), 1e-8))')} AS centroid_cosine, (SELECT round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) FROM embeddings WHERE label < 5) AS mean_norm FROM b""",
)
def _(t):
    v = vectors(t)
    return _rounded(M.distribution_match(v.filter("label < 5"), v.filter("label >= 5"), "v"))


@query(
    "node_decode_accuracy",
    f"""{_COMPARED}, m AS (SELECT graph_id, sum(abs(x - y)) = 0 AS ok FROM both_c GROUP BY ALL), z AS (SELECT CASE graph_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, ok FROM m)
    SELECT 256 AS dim, coalesce(split, 'overall') AS split, count(*) FILTER (ok) AS matches, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM z GROUP BY ROLLUP (split)""",
)
def _(t):
    name = F.when(F.col("graph_id") % 3 == 0, "train").when(F.col("graph_id") % 3 == 1, "valid").otherwise("test")
    c = compare(t).withColumn("split", name).withColumn("dim", F.lit(256))
    return _rounded(M.node_decode_accuracy(c))


@query(
    "reconstruction_summary",
    f"WITH {_KEYS} SELECT count(*) AS num_samples, count(*) FILTER (valid) AS valid_count, round(avg(valid::INTEGER), 6) AS valid_rate, count(*) FILTER (final) AS match_count, round(avg(final::INTEGER), 6) AS match_rate, count(*) FILTER (value > 1000) AS node_decode_count, round(avg((value > 1000)::INTEGER), 6) AS node_decode_rate, round(avg(value / 30000), 6) AS mean_tanimoto, round(median(value / 30000), 6) AS median_tanimoto FROM k",
)
def _(t):
    rows = doc_keys(t).withColumn("ok", F.col("value") > 1000).withColumn("sim", F.col("value") / 30000)
    return _rounded(M.reconstruction_summary(rows, "valid", "final", "ok", "sim"))


_CE = f"""{WITH}, pr AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, coalesce(x.bond, 0) AS bond FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id LEFT JOIN bonds x ON x.graph_id = a.graph_id AND x.src = a.node_id AND x.dst = b.node_id),
l AS (SELECT graph_id, -ln([0.5, 0.2, 0.1, 0.1, 0.1][bond + 1]::DOUBLE) AS l FROM pr)"""


def _predicted(t):
    return G.all_pairs(t.nodes).drop("bond").withColumn("probs", F.array(*[F.lit(p) for p in (0.5, 0.2, 0.1, 0.1, 0.1)]))


@query("edge_cross_entropy", f"{_CE} SELECT {sql_r6('avg(l)')} AS loss FROM l")
def _(t):
    return _rounded(M.edge_cross_entropy(_predicted(t), t.bonds))


@query("edge_cross_entropy_per_graph", f"{_CE} SELECT {sql_r6('avg(l)')} AS loss FROM (SELECT avg(l) AS l FROM l GROUP BY graph_id)")
def _(t):
    return _rounded(M.edge_cross_entropy(_predicted(t), t.bonds, per_graph=True))
