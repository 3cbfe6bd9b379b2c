"""Encoders, codebooks and decoders against numpy, hand values and brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import graph_tables
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.functions import vsa as V
from braidvec.operators import codebook as C
from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.plans.tables import ORDER_BINS
from braidvec.schema import EncoderConfig, WalkConfig


def plain_encode(nodes, edges, book, depth, normalize, isolated="zero"):
    """Direct numpy encoding of one graph in the spatial domain (real vectors, circular convolution for HRR)."""
    known, matrix, vsa = book
    bind = (lambda a, b: np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)).real) if vsa == "HRR" else (lambda a, b: a * b)
    start = {n: matrix[i] for n, i in nodes}
    layers, first = [start], None
    unit = np.zeros(matrix.shape[1], matrix.dtype)
    one = np.ones_like(unit) if vsa != "HRR" else np.eye(1, matrix.shape[1])[0]
    for layer in range(depth):
        sums = {n: unit.copy() for n in start}
        for s, d in edges:
            sums[s] = sums[s] + layers[-1][d]
        if isolated == "identity":
            for n in start:
                if not any(s == n for s, _ in edges):
                    sums[n] = one
        state = {n: bind(layers[-1][n], sums[n]) for n in start}
        if layer == 0:
            first = sum(state.values())
        if normalize:
            state = {n: v / (np.linalg.norm(v) + 1e-8) for n, v in state.items()}
        layers.append(state)
    return sum(start.values()), first, sum(sum(x.values()) for x in layers)


def collect_graphs(nodes, edges, bins):
    indexed = C.with_index(nodes, bins)
    by_node, by_edge = {}, {}
    for r in indexed.collect():
        by_node.setdefault(r["graph_id"], []).append((r["node_id"], r["idx"]))
    for r in edges.collect():
        by_edge.setdefault(r["graph_id"], []).append((r["src"], r["dst"]))
    return {g: (n, by_edge.get(g, [])) for g, n in by_node.items()}


def vector(v):
    return np.array(v["re"]) + 1j * np.array(v["im"]) if hasattr(v, "re") else np.array(v)


@pytest.mark.parametrize("vsa", ["MAP", "HRR", "FHRR"])
@pytest.mark.parametrize("limit", [10_000, 0])
def test_encode_matches_numpy(spark, sample, vsa, limit):
    nodes, edges = (df.filter("graph_id < 40") for df in sample)
    for isolated in ("zero", "identity"):
        cfg = EncoderConfig(bins=ORDER_BINS, dim=16, depth=3, vsa=vsa, isolated=isolated)
        book = C.make_codebook(spark, ORDER_BINS, 16, vsa, 42)
        _, matrix = book.matrix()
        want = collect_graphs(nodes, edges, ORDER_BINS)
        got = {r["graph_id"]: r for r in E.encode(nodes, edges, cfg, limit=limit).collect()}
        assert got.keys() == want.keys()
        for g, (n, e) in want.items():
            expected = plain_encode(n, e, (None, B.from_engine(matrix, vsa, 16), vsa), 3, True, isolated)
            for name, value in zip(("node_terms", "edge_terms", "graph_embedding"), expected):
                assert np.allclose(vector(got[g][name]), value, atol=1e-9), (g, name)
        if vsa != "MAP":
            break


def test_terms_from_counts_match_encode(spark, sample):
    for vsa in ("MAP", "HRR", "FHRR"):
        cfg = EncoderConfig(bins=ORDER_BINS, dim=8, depth=1, vsa=vsa)
        book = C.make_codebook(spark, ORDER_BINS, 8, vsa, 42)
        full = {r["graph_id"]: r for r in E.encode(*sample, cfg).collect()}
        for r in E.node_terms(sample[0], book).collect():
            assert np.allclose(vector(r["node_terms"]), vector(full[r["graph_id"]]["node_terms"]))
        for r in E.edge_terms(*sample, book).collect():
            assert np.allclose(vector(r["edge_terms"]), vector(full[r["graph_id"]]["edge_terms"]), atol=1e-9)


def test_large_codebook_paths(spark, sample, monkeypatch):
    """A codebook above the size bound is joined or searched block by block, with the same result."""
    book = C.make_codebook(spark, ORDER_BINS, 64, "MAP", 42)
    nodes, edges = (df.filter("graph_id < 30") for df in sample)
    cfg = EncoderConfig(bins=ORDER_BINS, dim=64, depth=2, vsa="MAP")
    terms = E.node_terms(nodes, book).persist()
    small = [
        {(r[0], r[1], r[2]) for r in D.decode_counts(terms, book).collect()},
        {(r[0], r[1]) for r in D.nearest_entry(terms, book).collect()},
        {(r[0], r[1], r[2]) for r in D.decode_nodes_iterative(terms, book).collect()},
        {r["graph_id"]: r["graph_embedding"] for r in E.encode(nodes, edges, cfg).collect()},
    ]
    monkeypatch.setattr(C, "BROADCAST_CELLS", 64 * 70)
    monkeypatch.setattr(D, "BROADCAST_CELLS", 64 * 70)
    assert not book.fits and len(D.codebook_blocks(book)) == 3
    assert {(r[0], r[1], r[2]) for r in D.decode_counts(terms, book).collect()} == small[0]
    assert {(r[0], r[1]) for r in D.nearest_entry(terms, book).collect()} == small[1]
    assert {(r[0], r[1], r[2]) for r in D.decode_nodes_iterative(terms, book).collect()} == small[2]
    for r in E.encode(nodes, edges, cfg).collect():
        assert np.allclose(r["graph_embedding"], small[3][r["graph_id"]])


def test_two_atom_graph(spark):
    nodes, edges = graph_tables(spark, {1: ([(0, 0, 0, 3)] * 2, [(0, 1)])})
    for vsa in ("MAP", "HRR", "FHRR"):
        book = C.make_codebook(spark, (4, 5, 3, 5), 256, vsa, 42)
        assert book.table.count() == 300
        terms = E.node_terms(nodes, book)
        want = [(1, 3, 2)]
        assert [tuple(r) for r in D.decode_counts(terms, book).collect()] == want
        if vsa != "FHRR":
            assert [tuple(r) for r in D.decode_nodes_iterative(terms, book, 18).collect()] == [(1, 3, 2, False)]


def test_decode_edges_recovers_the_edges(spark, sample):
    nodes, edges = sample
    # Not MAP: there bind(a, a) is the same vector for every a.
    book = C.make_codebook(spark, ORDER_BINS, 4096, "HRR", 42)
    observed = C.prune_codebook(book, nodes.select("feat").distinct())
    truth = E.edge_pair_counts(nodes, edges, ORDER_BINS)
    want = {(r["graph_id"], r["a"], r["b"]): r["cnt"] for r in truth.collect()}
    counts = C.with_index(nodes, ORDER_BINS).groupBy("graph_id", "idx").agg(F.count("*").alias("cnt"))
    terms = E.edge_terms(nodes, edges, observed).persist()
    # Isolated nodes count as degree 1 in their tuple, so they are left out of this check.
    linked = edges.select("graph_id").distinct()
    got = D.decode_edges(terms.join(linked, "graph_id", "left_semi"), counts, observed)
    assert {(r["graph_id"], r["a"], r["b"]): r["cnt"] for r in got.collect()} == want
    free = D.decode_edges_free(terms, observed, pairs=truth.select("a", "b").distinct())
    assert {(r["graph_id"], r["a"], r["b"]): r["cnt"] for r in free.collect()} == want


def test_peel_against_a_direct_loop(spark, sample):
    book = C.make_codebook(spark, ORDER_BINS, 32, "HRR", 7)
    known, spectra = book.matrix()
    matrix = B.from_engine(spectra, "HRR", 32)
    terms = E.node_terms(sample[0], book).persist()
    got = {}
    for r in D.decode_nodes_iterative(terms, book, 18).collect():
        got.setdefault(r["graph_id"], Counter())[r["idx"]] = r["cnt"]
    eps = 0.01 * np.linalg.norm(matrix, axis=1).min()
    for r in terms.collect():
        x, picks, before = np.array(r["node_terms"]), Counter(), np.inf
        before = np.linalg.norm(x)
        while sum(picks.values()) < 18 and np.linalg.norm(x) > eps:
            best = int(np.argmax(matrix @ x / np.linalg.norm(matrix, axis=1)))
            x = x - matrix[best]
            if np.linalg.norm(x) > before:
                break
            before = np.linalg.norm(x)
            picks[int(known[best])] += 1
        assert got.get(r["graph_id"], Counter()) == picks


def test_ensemble_first_chunk_is_the_primary(spark, sample):
    one = EncoderConfig(bins=ORDER_BINS, dim=16, depth=2, vsa="HRR", seed=5)
    many = EncoderConfig(bins=ORDER_BINS, vsa="HRR", seed=5, members=((16, 2), (8, 1)))
    a = {r["graph_id"]: r for r in E.encode(*sample, one).collect()}
    for limit in (10_000, 0):
        for r in E.encode_ensemble(*(df.filter("graph_id < 20") for df in sample), many, limit=limit).collect():
            assert len(r["graph_embedding"]) == 24
            assert np.allclose(r["graph_embedding"][:16], a[r["graph_id"]]["graph_embedding"])
            assert np.allclose(r["node_terms"], a[r["graph_id"]]["node_terms"])


def test_split_walk_and_weights_on_both_paths(spark, sample):
    from braidvec.operators.graphs import pagerank
    from braidvec.operators.walks import augment_rw

    nodes, edges = (df.filter("graph_id < 40") for df in sample)
    cfg = EncoderConfig(bins=ORDER_BINS, dim=8, depth=2, vsa="MAP", walk=WalkConfig(ks=(2, 4), num_bins=3))
    wide = augment_rw(nodes, edges, cfg.walk).persist()
    a = {r["graph_id"]: r for r in E.encode_split_rw(wide, edges, cfg).collect()}
    for r in E.encode_split_rw(wide, edges, cfg, limit=0).collect():
        for c in ("node_terms", "edge_terms", "graph_embedding"):
            assert np.allclose(r[c], a[r["graph_id"]][c])
    with pytest.raises(ValueError):
        E.encode_split_rw(wide, edges, EncoderConfig(bins=ORDER_BINS))
    base = EncoderConfig(bins=ORDER_BINS, dim=8, depth=2, vsa="MAP")
    weights = pagerank(nodes, edges).withColumnRenamed("pagerank", "weight").persist()
    soft = edges.withColumn("weight", F.lit(0.5))
    for run in (lambda lim: E.encode_weighted_readout(nodes, edges, weights, base, lim), lambda lim: E.encode_soft(nodes, soft, base, limit=lim)):
        a = {r["graph_id"]: r["graph_embedding"] for r in run(10_000).collect()}
        assert all(np.allclose(r["graph_embedding"], a[r["graph_id"]]) for r in run(0).collect())


def test_spectral_algebra(spark):
    rng = np.random.default_rng(1)
    data = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(5)]
    df = spark.createDataFrame(data, "a array<double>, b array<double>")
    out = df.select("a", "b", V.circular_convolve("a", "b").alias("c"))
    out = out.withColumn("back", V.from_spectral(V.unbind(V.to_spectral("c"), V.to_spectral("a"), "HRR")))
    for r in out.collect():
        direct = [sum(r["a"][j] * r["b"][(k - j) % 8] for j in range(8)) for k in range(8)]
        assert np.allclose(r["c"], direct) and np.allclose(r["back"], r["b"])
    unit = spark.range(1).select(V.identity("HRR", 4, spectral=False).alias("i")).first()["i"]
    assert unit == [1.0, 0.0, 0.0, 0.0]


def test_degree_gap(spark):
    df = spark.createDataFrame([(2.5, 0.5), (1.333, 0.333)], "n double, b double").select(D.degree_gap("n", "b").alias("g"))
    assert [tuple(r["g"]) for r in df.collect()] == [(1, 1), (1, 2)]


def test_matchings_are_valid_graphs(spark, sample):
    from braidvec.operators.graphs import is_valid_graph

    pairs = E.edge_pair_counts(*sample, ORDER_BINS)
    nodes, edges = D.sample_matchings(pairs, ORDER_BINS, 3, 1)
    nodes, edges = nodes.persist(), edges.persist()
    assert nodes.count() > 0
    assert is_valid_graph(nodes, edges).filter("NOT valid").count() == 0
    # A candidate has at most the degrees its tuples ask for (merged repeats may lower them).
    degree = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("d"))
    over = nodes.join(degree, ["graph_id", "node_id"]).filter("d > feat[1] + 1")
    assert over.count() == 0


def test_exact_rate_of_the_flagship(spark, tables):
    from braidvec.catalog.decoding import decoded, truth
    from braidvec.operators.metrics import compare_counts

    for dim, exact in ((32, 133), (256, 1359), (1024, 1473)):
        assert compare_counts(decoded(tables, dim), truth(tables)).filter("exact_match").count() == exact


@pytest.mark.parametrize("size", [100, 1000])
def test_decoders_have_no_bound_of_their_own(spark, size):
    nodes, edges = graph_tables(spark, {1: ([(1, 0, 0, 0)] * size, []), 2: ([(0, 1, 0, 0), (2, 0, 1, 0)], [(0, 1)])})
    book = C.make_codebook(spark, (4, 2, 3, 2), 64, "MAP", 42)
    terms = E.node_terms(nodes, book)
    want = {(1, 12, size)} | {(2, r["idx"], 1) for r in C.with_index(nodes.filter("graph_id = 2"), book.bins).collect()}
    assert {tuple(r) for r in D.decode_nodes_iterative(terms, book).collect()} == want
    capped = {r["graph_id"]: (r["cnt"], r["capped"]) for r in D.decode_nodes_iterative(terms, book, 60).filter("graph_id = 1").collect()}
    assert capped == {1: (60, True)}


def test_pruned_books_fit_and_large_books_decode_edges(spark, monkeypatch):
    from braidvec import session
    from braidvec.operators import codebook as module

    nodes, edges = graph_tables(spark, {1: ([(1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 0, 1)], [(0, 1), (1, 2)]), 2: ([(0, 0, 0, 0)] * 2, [(0, 1)])})
    book = C.make_codebook(spark, (4, 3, 3, 2), 2048, "HRR", 42)
    counts = C.with_index(nodes, book.bins).groupBy("graph_id", "idx").agg(F.count("*").alias("cnt"))
    terms = E.edge_terms(nodes, edges, book).persist()
    want = {tuple(r) for r in D.decode_edges(terms, counts.withColumn("cnt", F.lit(1)), book).collect()}
    monkeypatch.setattr(module, "BROADCAST_CELLS", 6 * 2048 * 2)
    pruned = C.prune_codebook(book, nodes.select("feat").distinct())
    assert not book.fits and pruned.rows == 4 and pruned.fits and len(pruned.matrix()[0]) == 4
    assert {tuple(r) for r in D.decode_edges(terms, counts.withColumn("cnt", F.lit(1)), book).collect()} == want
    assert session.BROADCAST_CELLS > 6 * 2048 * 2


def test_unknown_ids_are_errors(spark, sample):
    nodes, edges = (df.filter("graph_id < 3") for df in sample)
    book = C.make_codebook(spark, ORDER_BINS, 64, "HRR", 42)
    observed = C.prune_codebook(book, nodes.select("feat").distinct())
    terms = E.edge_terms(nodes, edges, observed)
    known = {r["idx"] for r in observed.table.select("idx").collect()}
    stranger = next(k for k in range(math.prod(ORDER_BINS)) if k not in known)
    counts = terms.select("graph_id", F.lit(stranger).cast("long").alias("idx"), F.lit(1).cast("long").alias("cnt"))
    with pytest.raises(Exception, match="not in the codebook"):
        D.decode_edges(terms, counts, observed).collect()
