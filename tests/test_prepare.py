"""The order graphs: one exchange builds them, and both ways of ranking give the same rows."""

import pytest
from pyspark.sql import functions as F

from braidvec.operators import encode as E
from braidvec.operators import graphs as G
from braidvec.operators.graphs import degrees
from braidvec.plans import skew
from braidvec.plans.tables import Tables
from braidvec.schema import EncoderConfig


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines_take_one_exchange_and_no_join(spark, tables):
    plan = tables.lines._jdf.queryExecution().optimizedPlan().toString()
    raw = Tables(spark, tables.root)
    nodes = raw.nodes._jdf.queryExecution().withCachedData().toString()
    assert "Join" not in plan and "Join" not in nodes


def test_nodes_carry_the_degrees_of_the_edges(tables):
    real = degrees(tables.lines, tables.edges).withColumn("f1", F.greatest(F.col("degree").cast("int") - 1, F.lit(0)))
    wrong = tables.nodes.join(real, ["graph_id", "node_id"], "full").filter("NOT coalesce(feat[1] = f1, false)")
    assert wrong.count() == 0 and tables.nodes.count() == tables.lines.count()


@pytest.mark.parametrize("limit", [3, 40])
def test_group_rank_gives_sizes_and_earlier_values_both_ways(spark, limit):
    data = [(k % 5 if k % 2 else 0, (k * 37) % 101, float(k)) for k in range(90)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(data, "k long, o long, v double").filter("k IS NOT NULL")
    order = [F.col("o"), F.col("v")]
    want = rows_of(skew.with_group_rank(df, ["k"], order, "at", 1000, "n", ("v", 2, "before")))
    assert rows_of(skew.with_group_rank(df, ["k"], order, "at", limit, "n", ("v", 2, "before"))) == want
    own = {}
    for k, o, v in sorted(r for r in data if r[0] is not None):
        own.setdefault(k, []).append((o, v))
    assert want == sorted(((k, o, v, i, x[i - 2][1] if i > 1 else None, len(x)) for k, x in own.items() for i, (o, v) in enumerate(x)), key=repr)


@pytest.mark.parametrize("buckets", [1, 4, 1 << 16])
def test_large_keys_are_found_whatever_bucket_they_share(spark, monkeypatch, buckets):
    monkeypatch.setattr(skew, "KEY_BUCKETS", buckets)
    df = spark.createDataFrame([(k,) for k in range(300) for _ in range(30 if k in (7, 250) else 1)] + [(None,)] * 25, "k long")
    assert {r[0] for r in skew.large_keys(df, ["k"], 20).collect()} == {7, 250, None}
    assert skew.large_keys(df, ["k"], 30) is None


def test_hash_of_ordinary_graphs_takes_one_join_and_agrees_with_the_spread_way(spark, monkeypatch):
    nodes = spark.createDataFrame([(g, i, [i % 3, g % 2, 0, 0]) for g in range(12) for i in range(2 + g % 5)], "graph_id long, node_id int, feat array<int>")
    ends = [(g, i, (i * 2 + g) % (2 + g % 5)) for g in range(12) if g != 4 for i in range(2 + g % 5)]  # one way only, with loops; graph 4 has none
    edges = spark.createDataFrame(ends, "graph_id long, src int, dst int")
    hashed = G.graph_hash(nodes, edges)
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 1  # three rounds took one each
    monkeypatch.setattr(G, "GRAPH_LIMIT", 0)
    assert rows_of(G.graph_hash(nodes, edges)) == rows_of(hashed)


def test_graph_vectors_alone_and_three_vectors_from_one_encoding(spark, sample):
    from braidvec.catalog.encoding import _three

    nodes, edges = sample
    cfg = EncoderConfig(bins=(3, 6, 2, 5), dim=8, depth=2, vsa="MAP", seed=1, normalize=True)
    whole = E.encode(nodes, edges, cfg)
    for limit in (E.GRAPH_LIMIT, 0):
        alone = E.encode(nodes, edges, cfg, limit=limit, terms=False)
        assert alone.columns == ["graph_id", "graph_embedding"]
        far = alone.withColumnRenamed("graph_embedding", "v").join(whole, "graph_id").selectExpr("exists(zip_with(v, graph_embedding, (x, y) -> abs(x - y)), d -> d > 1e-9) AS far")
        assert {r[0] for r in far.collect()} == {False}
    long = _three(whole)
    assert long._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # three encodings before
    assert long.count() == 24 * whole.count()
