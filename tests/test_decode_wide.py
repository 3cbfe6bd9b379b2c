"""Edges peeled with more pairs than one task may hold: the same pairs as the small way finds."""

import numpy as np
import pytest

from braidvec.operators import decode as D
from braidvec.operators import decode_wide as W
from braidvec.operators import encode as E
from braidvec.operators.codebook import make_codebook

DIM = 128


def vectors(spark, book, sizes, top, seed):
    rng = np.random.default_rng(seed)
    rows = [(g, int(a), int(b), 1) for g, n in enumerate(sizes) for x, y in zip(*rng.integers(0, top, (2, n)), strict=True) for a, b in ((x, y), (y, x))]
    counts = spark.createDataFrame(rows, "graph_id long, a long, b long, cnt long")
    keys = spark.range(len(sizes)).toDF("graph_id")
    return counts, E.encode_edge_multiset(counts, book, keys=keys)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("graph_id", "a", "b", "cnt").collect())


@pytest.mark.parametrize(("vsa", "limit"), [("HRR", None), ("HRR", 4), ("FHRR", None)])
def test_every_way_finds_the_same_pairs(spark, monkeypatch, vsa, limit):
    book = make_codebook(spark, (4, 5), DIM, vsa, 3)
    counts, embedded = vectors(spark, book, [3, 1, 0, 4], 20, 1)
    embedded = embedded.persist()
    column = "edge_vector"
    pairs = counts.select("a", "b")
    want = rows(D.decode_edges_free(embedded, book, limit, vector=column))
    assert limit or want == rows(counts.groupBy("graph_id", "a", "b").count().withColumnRenamed("count", "cnt"))
    monkeypatch.setattr(W, "TILE", 3)
    monkeypatch.setattr(W, "STRIPS", 4)
    plain = embedded.selectExpr("graph_id", f"{column} as v")
    count = lambda df: rows(df.groupBy("graph_id", "a", "b").count().withColumnRenamed("count", "cnt"))
    for cells in (10**6, 7 * DIM):  # one block, and several
        assert count(W.decode_pairs_by_rounds(plain, book, None, limit, "graph_id", cells)) == want
    some = rows(D.decode_edges_free(embedded, book, limit, pairs, vector=column))
    blocks = W.pair_blocks(pairs, book, 5 * DIM)
    assert len(blocks) > 1 and count(W.decode_pairs_by_rounds(plain, book, blocks, limit, "graph_id")) == some
    whole = W.pair_blocks(pairs, book, 10**9)
    assert len(whole) == 1 and count(W.decode_pairs_in_tasks(plain, whole[0], book, limit, "graph_id")) == some


def test_a_layout_of_279936_rows(spark):
    """Six values in each of seven places: the pairs that occur are searched, nothing raises."""
    book = make_codebook(spark, (6,) * 7, 64, "HRR", 3)
    assert book.rows == 279_936
    counts, embedded = vectors(spark, book, [2, 3, 0], 279_936, 2)
    embedded = embedded.persist()
    out = D.decode_edges_free(embedded, book, pairs=counts.select("a", "b"), vector="edge_vector")
    assert rows(out) == rows(counts.groupBy("graph_id", "a", "b").count().withColumnRenamed("count", "cnt"))
    capped = D.decode_edges_free(embedded, book, 4, counts.select("a", "b"), vector="edge_vector")
    assert {(r.graph_id, r.capped) for r in capped.collect()} == {(0, True), (1, True)}
    with pytest.raises(Exception, match="not in the codebook"):
        D.decode_edges_free(embedded, book, pairs=spark.createDataFrame([(0, 10**9)], "a long, b long"), vector="edge_vector").collect()


def test_search_takes_the_first_of_equal_pairs():
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(9, 6))
    matrix[7] = matrix[2]
    weights = np.ones(6)
    e = np.stack([matrix[2] * matrix[4], matrix[8] * matrix[8]])
    _, row, column = W.search_tiles(e, matrix, 0, matrix, weights, np.full(2, 1e-12))
    assert row.tolist() == [2, 8] and column.tolist() == [4, 8]
    assert W.shortest_pair(matrix, 0, matrix, weights) == pytest.approx(min(np.linalg.norm(a * b) for a in matrix for b in matrix))
