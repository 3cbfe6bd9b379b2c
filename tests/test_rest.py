"""Statistics, similarity, sources, fragments, streams and the catalogue."""

import itertools
import math

import numpy as np
import pytest
from conftest import SMALL, graph_tables
from pyspark.sql import functions as F

from braidvec.functions.properties import PropertyRegistry, target_vector
from braidvec.operators import fragments as X
from braidvec.operators import metrics as M
from braidvec.operators import similarity as S
from braidvec.operators import stats as T
from braidvec.schema import EncoderConfig, WalkConfig
from braidvec.sources import io
from braidvec.streaming import streams as ST


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(i, v.tolist(), (v[:2] * 2 + 1).tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, y array<double>").repartition(7).persist()


def test_moments_and_pca(cloud):
    x, df = cloud
    m = T.moments(df, "v")
    assert m.n == 300 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.covariance(), np.cov(x.T))
    pca = T.pca_fit(df, "v", 3)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(pca.components), np.abs(vt[:3])) and np.allclose(pca.ratio, s**2 / (s**2).sum())
    got = {r["id"]: r["projected"] for r in T.pca_project(df, "v", pca).collect()}
    assert np.allclose([got[i] for i in range(300)], (x - x.mean(axis=0)) @ pca.components.T)
    trip = T.pca_roundtrip(df, "v", pca).first()
    back = (x - pca.mean) @ pca.components.T @ pca.components + pca.mean
    d = 1 - (x * back).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(back, axis=1)
    assert np.allclose([trip["mean"], trip["max"], trip["median"]], [d.mean(), d.max(), np.sort(d)[149]])


def test_linear_map(cloud):
    x, df = cloud
    rng = np.random.default_rng(9)
    noise = {i: rng.normal(size=2) for i in range(300)}
    y = np.array([x[i, :2] * 2 + 1 + noise[i] for i in range(300)])
    both = df.sparkSession.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(300)], "x array<double>, y array<double>")
    model = T.fit_linear_map(both, "x", "y")
    want, *_ = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)
    assert np.allclose(model.weights, want[:-1]) and np.allclose(model.bias, want[-1])
    assert math.isclose(model.mse, ((np.c_[x, np.ones(300)] @ want - y) ** 2).mean(), rel_tol=1e-6)


def test_frechet(cloud):
    x, df = cloud
    a, b = df.filter("id < 150"), df.filter("id >= 150")
    got = M.frechet_distance(a, b, "v")
    p, q = x[:150], x[150:]
    values = np.linalg.eigvals(np.cov(p.T) @ np.cov(q.T))
    want = ((p.mean(0) - q.mean(0)) ** 2).sum() + np.trace(np.cov(p.T)) + np.trace(np.cov(q.T)) - 2 * np.sqrt(values.real.clip(0)).sum()
    assert math.isclose(got, want, rel_tol=1e-6)
    assert abs(M.frechet_distance(a, a, "v")) < 1e-6


def test_pairwise_cosine_without_pairs(cloud):
    x, df = cloud
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = [float(u[i] @ u[j]) for i, j in itertools.combinations(range(300), 2)]
    r = S.mean_pairwise_cosine(df, "v").first()
    assert math.isclose(r["mean"], np.mean(c), rel_tol=1e-6) and math.isclose(r["std"], np.std(c, ddof=1), rel_tol=1e-5)


def test_diversity_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    sets = [sorted({int(b) for b in rng.integers(0, 40, rng.integers(0, 9))}) for _ in range(120)] + [[1, 2, 3]] * 60 + [[]] * 3
    df = spark.createDataFrame([(s,) for s in sets], "bits array<int>")

    def sim(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    want = np.mean([sim(a, b) for a, b in itertools.combinations(sets, 2)])
    for block in (4096, 10):
        assert math.isclose(S.mean_pairwise_tanimoto(df, nbits=64, block_rows=block).first()["mean"], want, rel_tol=1e-9)
    assert S.internal_diversity(df.limit(1)).first()["diversity"] == 0.0


def test_moving_average_of_a_long_series(spark):
    rows = [("a", i, float((i * 37) % 11)) for i in range(500)] + [("b", i, float(i)) for i in range(3)] + [("a", 500, float("nan"))]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    whole = {(r["k"], r["t"]): r["smooth"] for r in T.moving_average(df, "k", ["t"], "v", 5).collect()}
    split = {(r["k"], r["t"]): r["smooth"] for r in T.moving_average(df, "k", ["t"], "v", 5, limit=50).collect()}
    assert whole.keys() == split.keys() and len(whole) == 503
    assert all(math.isclose(whole[k], split[k], abs_tol=1e-12) for k in whole)
    assert [whole["b", i] for i in range(3)] == [0.0, 1.0, 2.0]


def test_empty_and_short_inputs(spark):
    short = spark.createDataFrame([(1.0,)], "v double")
    assert M.kl_divergence(short, short, "v").first()["kl"] is None
    assert M.top_k_mean(short, "v", 2).first()["top_mean"] is None
    empty = spark.createDataFrame([], "key string, valid boolean")
    assert M.generation_metrics(empty, empty.select("key")).first()["validity"] == 0.0
    score = spark.range(1).select(M.composite_score([F.lit(0.5), F.lit(0.0)]), M.composite_score([F.lit(0.5), F.lit(None).cast("double")]))
    assert score.first()[:] == (0.0, None)


def test_contrastive_score_does_not_depend_on_the_block(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 2, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in range(41)]
    df = spark.createDataFrame(rows, "b int, x array<double>, y array<double>")
    whole, cut = ({r.b: (r.n, r.loss) for r in T.info_nce(df, "b", "x", "y", 0.5, block=k).collect()} for k in (1000, 3))
    for b in (0, 1):
        x, y = (np.array([r[k] for r in rows if r[0] == b]) for k in (1, 2))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        z = x @ y.T / 0.5
        want = ((np.log(np.exp(z).sum(1)) - np.diag(z)).mean() + (np.log(np.exp(z).sum(0)) - np.diag(z)).mean()) / 2
        assert whole[b][0] == cut[b][0] == len(x)
        assert abs(whole[b][1] - want) < 1e-12 and abs(cut[b][1] - want) < 1e-12


def test_label_rules(spark):
    pairs = {tuple(r) for r in X.label_rules(spark).collect()}
    assert (1, 3) in pairs and (7, 7) in pairs and (1, 2) not in pairs
    assert all((b, a) in pairs for a, b in pairs)
    assert all((0, x) in pairs and (x, 0) in pairs for x in range(17))


def fragment(spark, graphs):
    nodes, edges = graph_tables(spark, {g: ([f for f, _ in ns], es) for g, (ns, es) in graphs.items()})
    labels = [(g, i, label) for g, (ns, _) in graphs.items() for i, (_, label) in enumerate(ns)]
    return nodes.join(spark.createDataFrame(labels, "graph_id long, node_id int, label int"), ["graph_id", "node_id"]), edges


def test_combine_and_strip(spark):
    c = (1, 0, 0, 2)
    left = fragment(spark, {1: ([(c, None), (c, None), (c, 1)], [(0, 1), (1, 2)]), 2: ([(c, None), (c, 2)], [(0, 1)])})
    right = fragment(spark, {1: ([(c, 3), (c, None)], [(0, 1)]), 2: ([(c, 1), (c, None)], [(0, 1)])})
    nodes, edges = X.combine_fragments(left, right, X.label_rules(spark), 1)
    assert sorted((r["graph_id"], r["node_id"]) for r in nodes.collect()) == [(1, 0), (1, 1), (1, 4)]
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(0, 1), (1, 0), (1, 4), (4, 1)]
    n, e = X.strip_dummies(*left)
    assert {r["graph_id"] for r in n.collect()} == {1} and e.count() == 2


def test_assembled_graphs_are_connected(spark):
    from braidvec.operators.graphs import is_valid_graph

    c = (1, 0, 0, 2)
    chain = [(0, 1), (1, 2), (2, 3)]
    nodes, edges = fragment(spark, {g: ([(c, label), (c, None), (c, None), (c, label)], chain) for g, label in ((1, 7), (2, 5), (3, 16), (4, 0))})
    items = spark.range(30).withColumnRenamed("id", "item_id")
    draws = X.sample_fragments(items, nodes.select("graph_id").distinct(), 2, 3).persist()
    assert draws.count() == 60 and draws.groupBy("item_id").agg(F.countDistinct("fragment_id").alias("k")).filter("k < 2").count() == 0
    made, bonds = X.assemble(draws, nodes, edges, 2, X.label_rules(spark), 1)
    sizes = made.groupBy("graph_id").agg(F.count("*").alias("n"), F.count("label").alias("dummies")).collect()
    label = {1: 7, 2: 5, 3: 16, 4: 0}
    rules = {tuple(r) for r in X.label_rules(spark).collect()}
    by_item = {}
    for r in draws.collect():
        by_item.setdefault(r["item_id"], []).append(label[r["fragment_id"]])
    assert {r["graph_id"] for r in sizes} == {i for i, (a, b) in by_item.items() if (a, b) in rules}
    # Two inner nodes of each fragment stay; the joined and the left-over dummies go.
    assert all((r["n"], r["dummies"]) == (4, 0) for r in sizes)
    assert is_valid_graph(made, bonds).filter("NOT valid").count() == 0


def test_labels_of_points_take_no_exchange(spark):
    """A point stands for each label it goes with, and these rows stay where their points were brought together."""
    nodes, edges = fragment(spark, {1: ([((1, 0, 0, 2), 7), ((1, 0, 0, 2), None)], [(0, 1)])})
    points = X.cut_lineage(X.attachment_points(nodes, edges))
    picked = X._picked(points, points, X.label_rules(spark), 1)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
    # Label 7 goes with itself only; the neighbour of point 0 is node 1.
    assert [tuple(r) for r in picked.collect()] == [(1, 0, 1, 0, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "train_smile.txt").write_text("smiles\nCCO extra\n\n  C.C\nc1ccccc1\n")
    for name in ("valid", "test"):
        (tmp_path / f"{name}_smile.txt").write_text("CC\n")
    got = sorted(tuple(r) for r in io.read_splits(spark, str(tmp_path)).collect())
    assert got == [("CC", "test"), ("CC", "valid"), ("CCO", "train"), ("c1ccccc1", "train")]
    with pytest.raises(ValueError, match="unknown split"):
        io.read_splits(spark, str(tmp_path), ["dev"])
    (tmp_path / "pool.csv").write_text("smiles,source\n CCO ,a\n,b\n")
    assert [tuple(r) for r in io.read_pool_csv(spark, str(tmp_path / "pool.csv")).collect()] == [("CCO", "a")]
    with pytest.raises(ValueError, match="missing"):
        io.read_pool_csv(spark, str(tmp_path / "pool.csv"), "key")


def test_encoder_files(spark, tmp_path):
    cfg = EncoderConfig(bins=(2, 3), dim=8, depth=2, kind="walk", walk=WalkConfig(ks=(2,), num_bins=2, boundaries={2: (0.5,)}, clip=(0.0, 1.0)))
    io.save_encoder(str(tmp_path / "e"), cfg, io.encoder_codebooks(spark, cfg), spark)
    back, books = io.load_encoder(spark, str(tmp_path / "e"), "walk")
    assert back == cfg and books["nodes"].rows == 6 and books["full"].rows == 12
    with pytest.raises(ValueError, match="kind"):
        io.load_encoder(spark, str(tmp_path / "e"), "ensemble")


def test_properties():
    registry = PropertyRegistry()
    registry.register_property("a", lambda df: F.lit(1.0))
    with pytest.raises(KeyError, match="known"):
        registry.get_property("b")
    assert target_vector(["a", "b"], {"b": 2, "a": 1}) == [1.0, 2.0] and target_vector(["a"], 3) == [3.0]
    with pytest.raises(ValueError):
        target_vector(["a", "b"], 1.0)


def test_stream_encode_equals_batch(spark, sample):
    from braidvec.operators.encode import encode, encode_split_rw
    from braidvec.operators.walks import augment_rw

    nodes, edges = sample
    nested = ST.nested_graphs(nodes, edges)
    walk = WalkConfig(ks=(2, 3), num_bins=4)
    bins = (3, 6, 2, 5)
    for cfg in (EncoderConfig(bins=bins, dim=16, depth=2, vsa="HRR"), EncoderConfig(bins=bins, dim=16, depth=2, vsa="HRR", walk=walk)):
        batch = encode(nodes, edges, cfg) if cfg.walk is None else encode_split_rw(augment_rw(nodes, edges, walk), edges, cfg)
        want = {r["graph_id"]: np.array(r["node_terms"] + r["graph_embedding"], np.float32) for r in batch.collect()}
        got = {r["graph_id"]: r["vector"] for r in ST.stream_encode(nested, cfg).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=1e-6) for g in want)


def test_mixing_shares(spark):
    pools = {"a": ST.index_pool(spark.range(10), ["id"]), "b": ST.index_pool(spark.range(3), ["id"])}
    rows = spark.range(5000).withColumnRenamed("id", "value")
    out = ST.mix_streams(rows, pools, {"a": 0.8, "b": 0.2}, 1)
    assert out.count() == 5000
    assert 0.77 < out.filter("source = 'a'").count() / 5000 < 0.83
    for bad in ({"pools": {}, "weights": {}}, {"pools": pools, "weights": {"a": 0, "b": 0}}):
        with pytest.raises(ValueError):
            ST.mix_streams(rows, bad["pools"], bad["weights"], 1)


def test_steps_of_an_endless_stream(spark, tmp_path):
    seen = []
    stream = ST.draws(spark, 8)
    ST.run_steps(stream, 3, lambda batch, number: seen.append((number, batch.count())), str(tmp_path))
    assert seen == [(0, 8), (1, 8), (2, 8)]


def test_catalogue(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 150
    row = entry.entry(spark).first()
    assert (row["graphs"], row["exact"]) == (1473, 1359)


@pytest.mark.parametrize("name", ["feature_index", "rw_return", "graph_hash", "components", "edge_terms", "encode", "decode_counts", "edge_iou", "random_split", "combine_fragments", "stream_validate"])
def test_against_sql(spark, name):
    import duckdb

    from braidvec.catalog.check import compare

    connection = duckdb.connect()
    for table in "orders lineitem events documents embeddings part labels customer".split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert compare(spark, connection, SMALL, name).startswith("ok")
