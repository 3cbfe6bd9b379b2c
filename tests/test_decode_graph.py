"""Whole graphs from vectors, against all matchings of small graphs."""

import itertools
from collections import Counter

import numpy as np
import pytest
from conftest import graph_tables

from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.operators.codebook import make_codebook
from braidvec.operators.decode_graph import DecodeSettings, decode_graph
from braidvec.schema import EncoderConfig

BINS, DIM = (3, 4), 128
CFG = EncoderConfig(bins=BINS, dim=DIM, depth=2, vsa="HRR", seed=9)


def feats(kinds, pairs):
    degree = Counter(x for p in pairs for x in p)
    return [(k, max(degree[i] - 1, 0)) for i, k in enumerate(kinds)]


GRAPHS = {
    1: ("012", [(0, 1), (1, 2)]),
    2: ("0000", [(0, 1), (1, 2), (2, 3), (3, 0)]),
    3: ("0101", [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]),
    4: ("011", [(0, 1), (1, 2), (2, 0)]),
    5: ("0", []),
    6: ("00112", [(0, 1), (1, 2), (2, 3), (3, 4)]),
    7: ("0011", [(0, 1), (2, 3)]),  # two parts: no connected graph has these edges
}


def queries(spark, graphs):
    nodes, edges = graph_tables(spark, {g: (feats([int(k) for k in kinds], pairs), pairs) for g, (kinds, pairs) in graphs.items()})
    out = E.encode(nodes, edges, CFG)
    return nodes, edges, out.selectExpr("graph_id as query_id", "edge_terms as edge_vector", "graph_embedding as graph_vector")


def all_matchings(kinds, pairs):
    """Every connected loop-free graph with these nodes and edge kinds, as sorted edges over nodes of known kind."""
    own = feats([int(k) for k in kinds], pairs)
    nodes = sorted(own)
    wanted = Counter(tuple(sorted((own[a], own[b]))) for a, b in pairs)
    out = set()
    possible = list(itertools.combinations(range(len(nodes)), 2))
    for chosen in itertools.combinations(possible, len(pairs)):
        if Counter(tuple(sorted((nodes[a], nodes[b]))) for a, b in chosen) != wanted:
            continue
        degree = Counter(x for p in chosen for x in p)
        if any(degree[i] != nodes[i][1] + 1 for i in range(len(nodes))):
            continue
        seen, todo = {0}, [0]
        while todo:
            x = todo.pop()
            for p in chosen:
                if x in p and (y := sum(p) - x) not in seen:
                    seen.add(y)
                    todo.append(y)
        if len(seen) == len(nodes):
            out.add(chosen)
    return nodes, out


def plain_vector(nodes, pairs, known, matrix):
    """Graph vector of one graph in the spatial domain."""
    index = [f[0] * BINS[1] + f[1] for f in nodes]
    state = np.array([matrix[known.tolist().index(i)] for i in index])
    total = state.copy()
    for _ in range(CFG.depth):
        sums = np.zeros_like(state)
        for a, b in pairs:
            sums[a] += state[b]
            sums[b] += state[a]
        state = np.fft.ifft(np.fft.fft(state) * np.fft.fft(sums)).real
        state /= np.linalg.norm(state, axis=1, keepdims=True) + 1e-8
        total += state
    return total.sum(0)


@pytest.fixture(scope="module")
def decoded(spark):
    _, _, q = queries(spark, GRAPHS)
    return decode_graph(q, CFG, settings=DecodeSettings(top_k=4, probe=40, rounds=1, samples=60))


def test_states(decoded):
    got = {r.query_id: r for r in decoded.states.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "decoded", 2: "decoded", 3: "decoded", 4: "decoded", 5: "no_edges", 6: "decoded", 7: "infeasible"}
    assert {k: r.edges for k, r in got.items()} == {k: 2 * len(p) for k, (_, p) in GRAPHS.items()}
    assert {k: r.sampled for k, r in got.items()} == {k: 0 if k == 5 else 40 if k == 7 else 100 for k in GRAPHS}


def test_ranked_graphs_match_all_matchings(spark, decoded):
    book = make_codebook(spark, BINS, DIM, "HRR", 9)
    known = np.array([r.idx for r in book.table.orderBy("idx").collect()])
    matrix = np.array([r.hv for r in book.table.orderBy("idx").collect()])
    nodes = {}
    for r in decoded.nodes.collect():
        nodes.setdefault(r.graph_id, {})[r.node_id] = tuple(r.feat)
    edges = {}
    for r in decoded.edges.collect():
        edges.setdefault(r.graph_id, []).append((r.src, r.dst))
    by_query = {}
    for r in decoded.ranked.collect():
        assert r.final and r.level == 0
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {1, 2, 3, 4, 6}
    for q, found in by_query.items():
        kinds, pairs = GRAPHS[q]
        own = feats([int(k) for k in kinds], pairs)
        target = plain_vector(own, pairs, known, matrix)
        cos = lambda v: v @ target / np.linalg.norm(v) / np.linalg.norm(target)  # noqa: B023, E731
        names, every = all_matchings(kinds, pairs)
        best = {round(cos(plain_vector(names, m, known, matrix)), 6) for m in every}
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and all(a.sim >= b.sim - 1e-9 for a, b in itertools.pairwise(found))
        assert round(found[0].sim, 6) == max(best) == 1.0
        for r in found:
            mine = nodes[r.cand_id]
            assert sorted(mine.values()) == sorted(own)
            undirected = [(a, b) for a, b in edges[r.cand_id] if a < b]
            assert sorted((b, a) for a, b in undirected) == sorted((a, b) for a, b in edges[r.cand_id] if a > b)
            order = sorted(mine)
            again = plain_vector([mine[k] for k in order], [(order.index(a), order.index(b)) for a, b in undirected], known, matrix)
            assert abs(cos(again) - r.sim) < 1e-6
            if len(undirected) == len(pairs):  # repeated pairs collapse into one edge
                assert round(r.sim, 6) in best


def test_early_stopping_draws_less_and_limits_are_told_apart(spark):
    _, _, q = queries(spark, GRAPHS)
    settings = DecodeSettings(top_k=1, probe=40, rounds=2, samples=5, early_stopping=True, edge_limit=8)
    got = {r.query_id: (r.status, r.sampled) for r in decode_graph(q, CFG, settings=settings).states.collect()}
    assert got == {1: ("decoded", 40), 2: ("decoded", 40), 3: ("too_large", 0), 4: ("decoded", 40), 5: ("no_edges", 0), 6: ("decoded", 40), 7: ("infeasible", 40)}


def test_inconsistent_edges_and_no_queries(spark):
    """Half of a triangle's edges do not use up whole nodes."""
    _, _, q = queries(spark, {4: GRAPHS[4]})
    book = make_codebook(spark, BINS, DIM, "HRR", 9)
    counts = spark.createDataFrame([(4, 1, 5, 1), (4, 5, 1, 1)], "query_id long, a long, b long, cnt long")
    half = E.encode_edge_multiset(counts, book, key="query_id").withColumnRenamed("edge_vector", "half")
    broken = q.join(half, "query_id").selectExpr("query_id", "half as edge_vector", "graph_vector")
    out = decode_graph(broken, CFG)
    assert [tuple(r) for r in out.states.collect()] == [(4, "inconsistent", 2, 0, 0, None)]
    assert out.ranked.count() == out.nodes.count() == out.edges.count() == 0
    assert decode_graph(q.limit(0), CFG).states.count() == 0
    with pytest.raises(ValueError):
        DecodeSettings(top_k=0)


def test_three_term_target(spark):
    nodes, edges, _ = queries(spark, {k: GRAPHS[k] for k in (1, 6)})
    terms = {r.graph_id: r for r in E.encode(nodes, edges, CFG).collect()}
    whole = {k: np.array(r.node_terms) + r.edge_terms + r.graph_embedding for k, r in terms.items()}
    q = spark.createDataFrame([(1, whole[1].tolist())], "query_id long, vector array<double>")
    mine = lambda t: t.selectExpr("*", "1L as query_id")
    got = {r.cand_id: r.sim for r in D.rank_candidates(q, mine(nodes), mine(edges), CFG, 2, target="sum").collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == pytest.approx({k: cos(whole[k], whole[1]) for k in (1, 6)}) and got[1] == pytest.approx(1)
    with pytest.raises(ValueError):
        D.rank_candidates(q, mine(nodes), mine(edges), CFG, target="nodes")


def test_sizes_are_counted_once(spark, monkeypatch):
    """Hashing and encoding of candidates share one table of sizes."""
    from braidvec.plans import skew

    nodes, edges, _ = queries(spark, {1: GRAPHS[1]})
    calls = []
    real = skew.graph_sizes
    counted = lambda n, e: calls.append(1) or real(n, e)
    monkeypatch.setattr(skew, "graph_sizes", counted)
    monkeypatch.setattr(D, "graph_sizes", counted)
    q = spark.createDataFrame([(1, [1.0] * DIM)], "query_id long, vector array<double>")
    assert D.rank_candidates(q, nodes.selectExpr("*", "1L as query_id"), edges.selectExpr("*", "1L as query_id"), CFG).count() == 1
    assert len(calls) == 1


def test_groups_of_graphs_give_what_all_give(spark, sample):
    from pyspark.sql import functions as F

    from braidvec.operators.decode_graph import decode_graph_of
    from braidvec.plans.tables import ORDER_BINS

    nodes, edges = (x.filter("graph_id < 30") for x in sample)
    cfg = EncoderConfig(bins=ORDER_BINS, dim=256, depth=3, vsa="HRR", seed=42)
    pairs = E.edge_pair_counts(nodes, edges, ORDER_BINS).select("a", "b").distinct()
    settings = DecodeSettings(top_k=2, probe=4, rounds=0, early_stopping=True)
    vectors = E.encode(nodes, edges, cfg).selectExpr("graph_id as query_id", "edge_terms as edge_vector", "graph_embedding as graph_vector")
    want = decode_graph(vectors.persist(), cfg, None, pairs, settings)
    got = decode_graph_of(nodes, edges, cfg, None, pairs, settings, at_once=10)
    for name in ("states", "ranked", "nodes", "edges"):
        a, b = getattr(got, name), getattr(want, name)
        round_ = lambda df: [F.round(c, 9).alias(c) if t == "double" else c for c, t in sorted(df.dtypes)]  # noqa: B023, E731
        assert sorted(str(r) for r in a.select(*round_(a)).collect()) == sorted(str(r) for r in b.select(*round_(b)).collect())
    assert got.states.count() == nodes.select("graph_id").distinct().count()
