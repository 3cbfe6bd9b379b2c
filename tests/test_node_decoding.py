"""Vectors of nodes decoded by the tasks that make them, and counts compared after one exchange."""

import numpy as np
import pytest
from conftest import graph_tables

from braidvec import session
from braidvec.operators import bundling
from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.operators import metrics as M
from braidvec.operators.codebook import make_codebook
from braidvec.plans.tables import ORDER_BINS


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(repr(r) for r in frame.collect())


@pytest.mark.parametrize("vsa", ["MAP", "HRR", "FHRR"])
def test_vectors_are_decoded_where_they_are_made(spark, sample, vsa):
    nodes, _ = sample
    book = make_codebook(spark, ORDER_BINS, 256, vsa, 42)
    terms = E.node_terms(nodes, book)
    for old, new in [
        (D.decode_counts(terms, book), D.decode_counts_of_nodes(nodes, book, 9)),
        (D.decode_nodes_iterative(terms, book), D.decode_nodes_iterative_of(nodes, book, parts=9)),
        (D.decode_nodes_iterative(terms, book, 3, debug=True), D.decode_nodes_iterative_of(nodes, book, 3, debug=True, parts=9)),
    ]:
        plan = plan_of(new)
        assert plan.count("MapInArrow") == 2 and plan_of(old).count("MapInArrow") == 3
        assert "hashpartitioning(graph_id" in plan and ", 9), REPARTITION_BY_NUM" in plan
        assert rows(new.drop("norms", "sims")) == rows(old.drop("norms", "sims"))


def test_counts_are_compared_after_one_exchange(spark):
    kind = "graph_id long, idx long, cnt long"
    found = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 5, 1), (2, 5, 1), (3, 9, 4)], kind)
    truth = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 6, 1), (2, 5, 1), (2, 7, 3), (4, 1, 1)], kind)
    out = M.compare_counts(found, truth, parts=7)
    plan = plan_of(out)
    assert plan.count("Exchange") == 1 and "Join" not in plan and "hashpartitioning(graph_id" in plan
    assert sorted(tuple(r) for r in out.collect()) == [(1, True, 0, 0, 3, 3), (2, False, 3, 1, 2, 4), (3, False, 0, 4, 4, 0), (4, False, 1, 0, 0, 1)]
    assert sorted(tuple(r) for r in M.edge_iou(found, truth, items=["idx"]).collect()) == [(1, 1.0), (2, 1 / 5), (3, 0.0), (4, 0.0)]


def test_parts_grow_with_a_persisted_table(spark, monkeypatch):
    kept = spark.range(1000).persist()
    usual = session.parts_for(kept)
    monkeypatch.setattr(session, "ROWS_A_PART", 10)
    assert usual == 4 and session.parts_for(kept) == 100
    kept.unpersist()


@pytest.mark.parametrize("gram", [0, 1 << 10])
@pytest.mark.parametrize("most", [None, 0, 4])
def test_peeling_agrees_with_peeling_one_by_one(monkeypatch, gram, most):
    monkeypatch.setattr(D, "GRAM_ROWS", gram)
    rng = np.random.default_rng(8)
    book = rng.normal(size=(30, 128)) / np.sqrt(128)
    x = np.stack([book[rng.integers(0, 30, n)].sum(0) if n else np.zeros(128) for n in (3, 0, 40, 1, 25)] + [rng.normal(size=128)])
    length = np.linalg.norm(book, axis=1)
    got = [[v[row == k].tolist() for k in range(len(x))] for row, v in D.peel(x, book, most, 0.01)]
    for k, rest in enumerate(x):
        picks, norms, sims = [], [], []
        while most is None or len(norms) < most:
            norm = float(np.linalg.norm(rest))
            norms.append(norm)
            if norm <= 0.01:
                break
            scores = book @ rest / length / norm
            best = int(scores.argmax())
            sims.append(float(scores[best]))
            if not np.linalg.norm(rest - book[best]) < norm:
                break
            picks.append(best)
            rest = rest - book[best]
        if most is None and len(sims) > len(picks):
            assert len(got[1][k]) == len(norms)
        assert got[0][k] == picks
        assert np.allclose(got[1][k], norms) and np.allclose(got[2][k], sims)


@pytest.mark.parametrize("steps", [1, 3, 32])
def test_sums_place_by_place_and_by_segments(spark, monkeypatch, steps):
    monkeypatch.setattr(bundling, "STEPS", steps)
    feats = [(1, 0, 0, 2), (0, 1, 1, 3), (1, 0, 0, 2), (2, 5, 1, 4), (0, 0, 0, 0)]
    nodes, _ = graph_tables(spark, {g: (feats[: 1 + g % 5], [(0, 0)]) for g in range(20)})
    book = make_codebook(spark, ORDER_BINS, 64, "HRR", 3)
    vectors = {r.idx: np.array(r.hv) for r in book.table.collect()}
    number = lambda f: ((f[0] * 6 + f[1]) * 2 + f[2]) * 5 + f[3]
    got = {r.graph_id: np.array(r.node_terms) for r in E.node_terms(nodes, book).collect()}
    for g in range(20):
        assert np.allclose(got[g], sum(vectors[number(f)] for f in feats[: 1 + g % 5]))
