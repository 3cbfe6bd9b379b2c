"""Edge vectors that are decoded in the tasks that make them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.operators import codebook as C
from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.plans.tables import ORDER_BINS


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def exchanged(df):
    """Columns of all exchanges of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(x for x in plan.splitlines() if "edge_terms" in x and ("Exchange" in x or "Sort" in x or "Join" in x))


@pytest.mark.parametrize("limit", [E.GRAPH_LIMIT, 12])
def test_decoded_where_made(spark, sample, limit):
    nodes, edges = sample
    book = C.make_codebook(spark, ORDER_BINS, 256, "HRR", 42)
    counts = E.with_index(nodes, ORDER_BINS).groupBy("graph_id", "idx").agg(F.count("*").alias("cnt"))
    found = D.decode_edges_of(nodes, edges, counts, book, limit)
    assert rows(found) == rows(D.decode_edges(E.edge_terms(nodes, edges, book), counts, book)) == rows(E.edge_pair_counts(nodes, edges, ORDER_BINS))
    assert limit == 12 or not exchanged(found)
    none = D.decode_edges_of(nodes, edges.limit(0), counts.filter("idx = -1"), book)
    assert none.count() == 0


@pytest.mark.parametrize("most", [None, 4])
def test_freely_decoded_where_made(spark, sample, monkeypatch, most):
    nodes, edges = sample
    book = C.make_codebook(spark, ORDER_BINS, 256, "HRR", 42)
    pairs = E.edge_pair_counts(nodes, edges, ORDER_BINS).select("a", "b").distinct()
    found = D.decode_edges_free_of(nodes, edges, book, most, pairs)
    assert found.columns == D.decode_edges_free(E.edge_terms(nodes, edges, book), book, most, pairs).columns
    assert rows(found) == rows(D.decode_edges_free(E.edge_terms(nodes, edges, book), book, most, pairs))
    assert most or rows(found) == rows(E.edge_pair_counts(nodes, edges, ORDER_BINS))
    assert not exchanged(found)


def test_bound_pairs_give_the_same_peeling():
    rng = np.random.default_rng(4)
    for vsa in ("HRR", "MAP"):
        matrix, weights = B.to_engine(rng.normal(size=(30, 64)) / 8, vsa), B.measure(vsa, 64)
        allowed = rng.random((30, 30)) < 0.3
        allowed |= allowed.T
        a, b = np.nonzero(np.triu(allowed))
        picks = rng.integers(0, len(a), (40, 4))
        e = 2 * (matrix[a[picks]] * matrix[b[picks]]).sum(1)
        kept = D.bound_pairs(matrix, allowed, weights)
        assert D.peel_pairs(e, matrix[None], allowed, None, weights, 0.01, kept) == D.peel_pairs(e, matrix[None], allowed, None, weights, 0.01)
