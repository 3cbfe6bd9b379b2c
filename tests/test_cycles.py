"""Chordless cycles against plain search, on both plans, and on shapes that defeat a search without an order."""

import itertools

import numpy as np
import pytest

from braidvec.operators import cycles
from braidvec.operators import graphs as G
from braidvec.operators import metrics as M

SCHEMA = "graph_id long, src int, dst int"


def table(spark, graphs):
    return spark.createDataFrame([(g, a, b) for g, pairs in graphs.items() for u, v in pairs for a, b in ((u, v), (v, u))], SCHEMA)


def plain_rings(pairs, longest):
    near = {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = set()
    for size in range(3, longest + 1):
        for nodes in itertools.combinations(sorted(near), size):
            inside = {u: near[u] & set(nodes) for u in nodes}
            if any(len(x) != 2 for x in inside.values()):
                continue
            path = [nodes[0], min(inside[nodes[0]])]
            while len(path) < size and (inside[path[-1]] - set(path)):
                path.append(min(inside[path[-1]] - set(path)))
            if len(path) == size:  # one ring, not several
                out.add("-".join(map(str, path)))
    return out


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.graph_id, r.ring_id, r.size), set()).add(r.node_id)
    assert all(set(map(int, ring.split("-"))) == nodes and len(nodes) == size for (_, ring, size), nodes in out.items())
    return {(g, ring) for g, ring, _ in out}


@pytest.mark.parametrize("limit", [1000, 0])
def test_random_graphs_match_plain_search(spark, limit, monkeypatch):
    monkeypatch.setattr(cycles, "PATHS_A_KEY", 3)
    monkeypatch.setattr(cycles, "NEIGHBOURS_A_KEY", 2)
    monkeypatch.setattr(cycles, "STEPS_AT_ONCE", 20)
    rng = np.random.default_rng(1)
    graphs = {g: [(int(u), int(v)) for u, v in rng.integers(0, 9, (int(rng.integers(1, 20)), 2))] for g in range(12)}
    got = found(G.short_cycles(table(spark, graphs), 6, limit))
    assert got == {(g, ring) for g, pairs in graphs.items() for ring in plain_rings(pairs, 6)}
    assert {ring for _, ring in got} and found(G.short_cycles(table(spark, graphs).limit(0), 6, limit)) == set()


def test_star_and_fan_cost_no_more_than_their_edges():
    star = np.array([(10_000, k) for k in range(10_000)])
    flat = cycles._Batch(np.zeros(len(star), np.int64), star[:, 0], star[:, 1])
    assert sum(map(len, flat.wedges())) == 0
    fan = np.array([e for k in range(0, 10_000, 2) for e in ((10_000, k), (10_000, k + 1), (k, k + 1))])
    flat = cycles._Batch(np.zeros(len(fan), np.int64), fan[:, 0], fan[:, 1])
    assert sum(map(len, flat.wedges())) == 5000 and sum(map(len, flat.rings(6))) == 5000


@pytest.mark.parametrize("limit", [500, 10**6])
def test_hubs_and_a_long_ring(spark, limit):
    """Above the limit and below it: a star, a fan of triangles and a ring, beside a small graph."""
    n = 3000
    graphs = {
        1: [(n, k) for k in range(n)],
        2: [e for k in range(0, n, 2) for e in ((n, k), (n, k + 1), (k, k + 1))],
        3: [(k, (k + 1) % n) for k in range(n)] + [(0, 5)],
        4: [(k, (k + 1) % 5) for k in range(5)],
    }
    got = found(G.short_cycles(table(spark, graphs), 6, limit, work_limit=10**12))
    assert got == {(2, f"{k}-{k + 1}-{n}") for k in range(0, n, 2)} | {(3, "0-1-2-3-4-5"), (4, "0-1-2-3-4")}


def test_work_limit_and_what_builds_on_rings(spark):
    """A large ring passes through the profile operators."""
    ring = [(k, (k + 1) % 600) for k in range(600)]
    edges = table(spark, {1: ring, 2: [(0, 1), (1, 2), (2, 0)]})
    nodes = spark.createDataFrame([(g, k, [k % 2, 1, 0, 0]) for g, n in ((1, 600), (2, 3)) for k in range(n)], "graph_id long, node_id int, feat array<int>")
    rings = G.short_cycles(edges, 6, limit=500)
    assert found(rings) == {(2, "0-1-2")} == found(G.short_cycles(edges, 6, work_limit=100))
    assert found(G.short_cycles(edges, 600, limit=10_000)) == {(2, "0-1-2"), (1, "-".join(map(str, range(600))))}
    assert {(tuple(r.feat), r["size"]) for r in G.ring_histogram(nodes, rings).collect()} == {((0, 1, 0, 0), 3), ((1, 1, 0, 0), 3)}
    assert M.structure_profile(nodes, edges.selectExpr("*", "1 as bond"), rings).count() > 0
