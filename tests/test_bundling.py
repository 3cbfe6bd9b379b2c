"""Grouped vector sums: values, what a task sends, and one graph with very many edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.operators import bundling
from braidvec.operators import encode as E
from braidvec.operators.codebook import Codebook, make_codebook

SCHEMA = "k string, j int, w double, hv array<double>"


def plain(rows, weighted):
    out = {}
    for k, j, w, hv in rows:
        if hv is not None:
            out[k, j] = out.get((k, j), 0) + np.array(hv) * (w if weighted else 1)
    return {key: v.tolist() for key, v in out.items()}


@pytest.mark.parametrize("cells", [1 << 22, 40])
@pytest.mark.parametrize("tree", [False, True])
def test_bundle_matches_plain_sums(spark, monkeypatch, cells, tree):
    monkeypatch.setattr(bundling, "HELD_CELLS", cells)
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None, "c"][k % 4], int(k % 3) if k % 7 else None, float(rng.integers(-3, 4)), rng.integers(-5, 6, 6).astype(float).tolist()) for k in range(500)]
    rows.append(("none", 1, 1.0, None))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for weight in (None, "w"):
        got = {(r.k, r.j): r.hv for r in bundling.bundle(frame, ["k", "j"], weight=weight, tree=tree).collect()}
        assert got == plain(rows, weight)
    both = frame.select("k", F.struct(F.col("hv").alias("re"), F.reverse("hv").alias("im")).alias("hv")).filter("hv.re is not null")
    got = {r.k: (r.hv.re, r.hv.im) for r in bundling.bundle(both, ["k"], tree=tree).collect()}
    want = plain([(k, 0, w, hv) for k, _, w, hv in rows], False)
    assert got == {k: (v, v[::-1]) for (k, _), v in want.items()}
    assert bundling.bundle(frame.limit(0), ["k"]).count() == 0


def test_one_array_a_key_and_task(spark):
    """A hundred thousand messages to three nodes: each task sends three arrays."""
    rows = spark.range(100_000, numPartitions=4).select((F.col("id") % 3).alias("node"), F.array_repeat(F.lit(1.0), 32).alias("hv"))
    partial = rows.mapInArrow(bundling._Combiner(["node"], "hv", None), "node long, hv array<double>")
    assert partial.count() == 12
    assert {r.node: r.hv for r in bundling.bundle(rows, ["node"]).collect()} == {k: [float(33334 - (k > 0))] * 32 for k in range(3)}
    plan = bundling.bundle(rows, ["node"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("vsa", ["MAP", "HRR", "FHRR"])
def test_counted_sums_of_small_and_very_large_keys(spark, monkeypatch, vsa):
    """Keys whose entries outweigh a vector send the vector; both ways, and keys split over tasks, give the same sums."""
    bins, dim = (4, 5), 8
    book = make_codebook(spark, bins, dim, vsa, 3)
    known, matrix = book.matrix()
    rng = np.random.default_rng(3)
    rows = [(int(g), int(a), int(b), int(n)) for g, size in enumerate([1, 3, 40, 5000, 0, 2]) for a, b, n in zip(*rng.integers(0, 20, (2, size)), rng.integers(1, 4, size), strict=True)]
    frame = spark.createDataFrame(rows, "graph_id long, a long, b long, cnt long").repartition(7)
    want = np.zeros((6, matrix.shape[1]), matrix.dtype)
    for g, a, b, n in rows:
        want[g] += n * matrix[a] * matrix[b]
    want = B.vector_column(B.from_engine(want, vsa, dim)).to_pylist()
    for held in (1 << 22, 1):
        monkeypatch.setattr(bundling, "HELD_CELLS", held)
        got = {r.graph_id: r.edge_vector for r in E.encode_edge_multiset(frame, book).collect()}
        assert set(got) == {0, 1, 2, 3, 5}
        for g, v in got.items():
            for part in ("re", "im") if vsa == "FHRR" else (None,):
                assert np.allclose(v[part] if part else v, want[g][part] if part else want[g], atol=1e-9)


def test_sent_rows_of_one_large_graph(spark):
    """A graph of 200 000 edges sends a vector a task."""
    book = make_codebook(spark, (30, 30), 16, "MAP", 1)
    edges = spark.range(200_000, numPartitions=4).select(F.lit(1).cast("long").alias("graph_id"), (F.col("id") % 900).alias("a"), (F.col("id") * 7 % 900).alias("b"), F.lit(1).alias("cnt"))
    sent = []
    real = type(edges).repartition
    type(edges).repartition = lambda self, *a: sent.append(self) or real(self, *a)
    try:
        total = E.encode_edge_multiset(edges, book)
    finally:
        type(edges).repartition = real
    assert sent[0].count() <= 8
    _, matrix = book.matrix()
    ids = np.arange(200_000)
    assert np.array_equal(total.first().edge_vector, (matrix[ids % 900] * matrix[ids * 7 % 900]).sum(0))


def test_spread_encoding_equals_batches_for_a_hub(spark):
    """A hub of 2000 leaves by both ways, and a codebook that is joined."""
    from dataclasses import replace

    from braidvec.schema import EncoderConfig

    n = 2000
    nodes = spark.createDataFrame([(1, k, [k % 3, k % 2]) for k in range(n + 1)], "graph_id long, node_id int, feat array<int>")
    edges = spark.createDataFrame([(1, a, b) for k in range(n) for a, b in ((n, k), (k, n))], "graph_id long, src int, dst int")
    for vsa in ("MAP", "HRR"):
        cfg = EncoderConfig(bins=(3, 2), dim=16, depth=2, vsa=vsa, seed=5)
        one, other = (E.encode(nodes, edges, cfg, limit=limit).first() for limit in (10**6, 10))
        for part in ("node_terms", "edge_terms", "graph_embedding"):
            assert np.allclose(one[part], other[part], atol=1e-6)
        book = make_codebook(spark, (3, 2), 16, vsa, 5)
        joined = replace(book, rows=1 << 40)
        assert not joined.fits and isinstance(joined, Codebook)
        assert np.allclose(E.edge_terms(nodes, edges, book).first().edge_terms, E.edge_terms(nodes, edges, joined).first().edge_terms, atol=1e-6)
