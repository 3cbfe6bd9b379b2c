"""Graph relations, walks and skew plans against hand values and brute force."""

import numpy as np
import pytest
from conftest import graph_tables
from pyspark.sql import functions as F

from braidvec.functions.features import bin_clipped, bin_quantile, bin_uniform, bin_walk, feature_index, feature_tuple
from braidvec.operators import graphs as G
from braidvec.operators import walks as W
from braidvec.plans import skew
from braidvec.schema import WalkConfig

F0 = (0, 0, 0, 0)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def shapes(spark):
    six = [(i, (i + 1) % 6) for i in range(6)]
    full = [(i, j) for i in range(4) for j in range(i)]
    return graph_tables(spark, {1: ([F0] * 3, [(0, 1), (1, 2)]), 2: ([F0] * 6, six), 3: ([F0] * 4, full), 4: ([F0], []), 5: ([F0] * 3, [(0, 1)])})


@pytest.mark.parametrize("limit", [1000, 0])
def test_walk_hand_values(shapes, limit):
    got = {(g, n): dict(zip((2, 3, 6), p)) for g, n, p in W.rw_return_wide(*shapes, (2, 3, 6), limit).collect()}
    assert [got[1, i][2] for i in range(3)] == [0.5, 1.0, 0.5]
    assert all(got[2, i][3] == 0 for i in range(6))
    assert len({round(got[2, i][6], 12) for i in range(6)}) == 1 and got[2, 0][6] > 0
    assert len({round(got[3, i][3], 12) for i in range(4)}) == 1
    assert got[4, 0] == {2: 1.0, 3: 1.0, 6: 1.0} and got[5, 2][3] == 1.0


def test_walk_paths_agree(sample):
    a = {(r[0], r[1]): r[2] for r in W.rw_return_wide(*sample, (1, 2, 3, 4, 7)).collect()}
    b = {(r[0], r[1]): r[2] for r in W.rw_return_wide(*sample, (1, 2, 3, 4, 7), 0).collect()}
    assert a.keys() == b.keys()
    assert max(np.abs(np.array(a[k]) - np.array(b[k])).max() for k in a) < 1e-12


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.15, 0.95, 1.0)], "v double")
    assert [r[0] for r in df.select(bin_uniform("v", 10)).collect()] == [0, 0, 1, 9, 9]
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.3, 0.5, 0.8)], "v double")
    assert [r[0] for r in df.select(bin_quantile("v", 3, [0.2, 0.5])).collect()] == [0, 0, 1, 1, 2, 2]
    assert [r[0] for r in df.select(bin_clipped("v", 2, 0.2, 0.6)).collect()] == [0, 0, 0, 0, 1, 1]
    walk = WalkConfig(ks=(4, 8), num_bins=4, boundaries={4: (0.25, 0.5)})
    df = spark.createDataFrame([(0.55,)], "v double")
    assert df.select(bin_walk("v", 4, walk), bin_walk("v", 8, walk)).first()[:] == (2, 2)
    # 5/12 stays below a boundary that was rounded up.
    assert spark.range(1).select(bin_quantile(F.lit(5 / 12), 3, [0.416667, 0.444444])).first()[0] == 0


def test_feature_index_is_a_bijection(spark):
    bins = (9, 6, 3, 4, 2)
    df = spark.range(9 * 6 * 3 * 4 * 2).select("id", feature_index(feature_tuple("id", bins), bins).alias("back"))
    assert df.filter("id <> back OR back IS NULL").count() == 0
    bad = spark.createDataFrame([([9, 0, 0, 0, 0],), ([0, 0, 0, 0],), ([-1, 0, 0, 0, 0],)], "f array<int>")
    assert [r[0] for r in bad.select(feature_index("f", bins)).collect()] == [None] * 3


def test_components_paths_agree(sample):
    nodes, edges = sample
    cut = edges.filter("NOT (least(src, dst) % 3 = 2 AND abs(src - dst) = 1)")
    cols = ("graph_id", "node_id", "label")
    assert rows(G.components(nodes, cut), *cols) == rows(G.components(nodes, cut, limit=0), *cols)


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    pairs = [(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 150]
    nodes, edges = graph_tables(spark, {9: ([F0] * n, pairs)})
    want = {int(order[i]): int(order[:151].min()) if i <= 150 else int(order[151:].min()) for i in range(n)}
    for limit in (10_000, 10):
        assert {r["node_id"]: r["label"] for r in G.components(nodes, edges, limit).collect()} == want


def test_pagerank_paths_agree(sample):
    nodes, edges = sample
    a = {tuple(r[:2]): r[2] for r in G.pagerank(nodes, edges, rounds=8).collect()}
    b = {tuple(r[:2]): r[2] for r in G.pagerank(nodes, edges, rounds=8, limit=0).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_hash_ignores_node_numbers(spark):
    feats, pairs = [(1, 0, 0, 0), (2, 1, 0, 0), (0, 1, 0, 0), (1, 0, 0, 1)], [(0, 1), (1, 2), (2, 3)]
    turned = [feats[i] for i in (3, 1, 0, 2)]
    at = {3: 0, 1: 1, 0: 2, 2: 3}
    moved = [(at[u], at[v]) for u, v in pairs]
    other = [(0, 1), (1, 2), (1, 3)]
    nodes, edges = graph_tables(spark, {1: (feats, pairs), 2: (turned, moved), 3: (feats, other)})
    got = {r["graph_id"]: (r["wl"], r["n"], r["m"]) for r in G.graph_hash(nodes, edges).collect()}
    assert got[1] == got[2] != got[3]
    assert rows(G.dedup_graphs(G.graph_hash(nodes, edges)), "graph_id", "copies") == [(1, 2), (3, 1)]


def test_group_rank_of_a_large_key(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("v"), "id", F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"))
    order = [F.col("v"), F.col("id")]
    a = skew.with_group_rank(df, ["k"], order, "r", limit=100)
    b = skew.with_group_rank(df, ["k"], order, "r")
    assert rows(a, "id", "r") == rows(b, "id", "r")


def test_order_statistics(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 50, 999)] + [7.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(6)
    n, got = skew.order_statistics(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0])
    assert n == 1499 and np.allclose(got, np.quantile(values, [0.0, 0.1, 0.5, 0.77, 1.0]))
    assert skew.order_statistics(df.filter("v < 3").limit(4), "v", [0.5], "lower")[1] == [sorted(r["v"] for r in df.filter("v < 3").limit(4).collect())[1]]
    assert skew.order_statistics(df.filter("v > 90"), "v", [0.5]) == (0, [])


def test_hash_split_is_exact(spark):
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    got = skew.smallest_by_hash(df, "h", "id", [777, 4000]).collect()
    want = [r["id"] for r in df.orderBy("h", "id").collect()]
    band = {r["id"]: r["band"] for r in got}
    assert [band[i] for i in want] == [0] * 777 + [1] * (4000 - 777) + [2] * 1000


def test_no_exchange_between_rounds(spark):
    """Tables hash-partitioned by graph_id are not shuffled again by joins and aggregates on (graph_id, node_id)."""
    nodes = spark.range(1000).select("id", (F.col("id") % 100).alias("graph_id"), (F.col("id") % 7).cast("int").alias("node_id"), F.array(F.lit(1)).alias("feat"))
    edges = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = G.wl_labels(skew.together(nodes), skew.together(edges), 3)
        plan = labels._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inside = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" not in line]
    assert not inside, plan


def test_unknown_tuple(spark):
    from braidvec.operators.codebook import with_index

    nodes, _ = graph_tables(spark, {1: ([(9, 9, 9, 9), F0], [])})
    with pytest.raises(Exception, match="outside the bins"):
        with_index(nodes, (2, 2, 2, 2)).collect()
    assert with_index(nodes, (2, 2, 2, 2), "drop").count() == 1


def test_short_cycles(spark):
    six = [(i, (i + 1) % 6) for i in range(6)]
    _, edges = graph_tables(spark, {1: ([F0] * 6, six), 2: ([F0] * 6, six + [(0, 3)]), 3: ([F0] * 4, [(i, j) for i in range(4) for j in range(i)])})
    for limit in (1000, 0):
        check_rings(G.short_cycles(edges, 6, limit))


def check_rings(found):
    rings = found.select("graph_id", "ring_id", "size").distinct().groupBy("graph_id", "size").count()
    assert rows(rings, "graph_id", "size", "count") == [(1, 6, 1), (2, 4, 2), (3, 3, 4)]


def test_preset_bounds():
    table = {3: {2: (0.1, 0.2)}}
    assert W.preset_bounds(table, 3)[2] == (0.1, 0.2)
    with pytest.raises(ValueError, match=r"available: \[3\]"):
        W.preset_bounds(table, 8)


def test_large_graphs_spread_whatever_the_input_partitioning(spark, sample, monkeypatch):
    """Edges that are a union of tables partitioned by graph_id, broadcast joins off, one graph above the limit."""
    ring = [(9_000_000, k, (k + 1) % 600, 1) for k in range(600)]
    nodes, edges = sample
    nodes = nodes.select("graph_id", "node_id", "feat").unionByName(spark.createDataFrame([(9_000_000, k, [k % 3, 1, 0, 0]) for k in range(600)], "graph_id long, node_id int, feat array<int>"))
    half = edges.filter("src < dst").select("graph_id", "src", "dst", "bond").unionByName(spark.createDataFrame(ring, "graph_id long, src int, dst int, bond int"))
    cols = ("graph_id", "wl", "n", "m")
    want = rows(G.graph_hash(nodes, G.double_edges(half).persist()), *cols)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        parted_nodes, parted = nodes.repartition(4, "graph_id"), G.double_edges(half.repartition(4, "graph_id"))
        monkeypatch.setattr(G, "GRAPH_LIMIT", 500)
        assert rows(G.graph_hash(parted_nodes, parted), *cols) == want
        assert G.components(parted_nodes, parted, limit=500).filter("graph_id = 9000000").select("label").distinct().count() == 1
        held = []
        skew.per_graph(parted_nodes, parted, lambda n, e, whole: held.append((whole, e)) or n, 500)
        spread = next(e for whole, e in held if not whole)
        assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
