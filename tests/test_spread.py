"""Codebooks that cannot be sent, on a grid with the vectors; pairs of graphs too large for one task."""

import pytest
from pyspark.sql import functions as F

from braidvec.operators import codebook as C
from braidvec.operators import decode as D
from braidvec.operators import encode as E
from braidvec.operators import graphs as G
from braidvec.plans.tables import ORDER_BINS


@pytest.mark.parametrize("vsa", ["HRR", "FHRR"])
def test_a_large_codebook_meets_the_vectors_on_a_grid(spark, sample, monkeypatch, vsa):
    book = C.make_codebook(spark, ORDER_BINS, 64, vsa, 42)
    nodes = sample[0].filter("graph_id < 60")
    terms = E.node_terms(nodes, book).persist()

    def answers():
        counts = {tuple(r) for r in D.decode_counts(terms, book).collect()}
        return counts, {(r[0], r[1], round(r[2], 9)) for r in D.nearest_entry(terms, book).collect()}

    want = answers()
    assert want[0] and len(want[1]) == terms.count()
    for module in (C, D):
        monkeypatch.setattr(module, "BROADCAST_CELLS", 64 * 70)
    monkeypatch.setattr(D, "GROUP_ROWS", 9)
    assert not book.fits
    assert answers() == want
    assert D.decode_counts(terms.limit(0), book).count() == 0 and D.nearest_entry(terms.limit(0), book).count() == 0


def test_the_input_is_evaluated_once(spark, sample, monkeypatch):
    """However many blocks the codebook has."""
    book = C.make_codebook(spark, ORDER_BINS, 64, "MAP", 42)
    terms = E.node_terms(sample[0].filter("graph_id < 20"), book).persist()
    n, seen = terms.count(), spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(C, "BROADCAST_CELLS", 64 * 20)
    monkeypatch.setattr(D, "BROADCAST_CELLS", 64 * 20)
    watched = terms.mapInArrow(watch, terms.schema)
    assert D.nearest_entry(watched, book).count() == n
    assert seen.value == n


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_pairs_of_large_graphs(spark, limit):
    rows = [(1, i) for i in range(40)] + [(2, i) for i in range(3)] + [(3, 7), (4, 0), (4, 1)]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id int").withColumn("extra", F.lit(1))
    got = sorted((r["graph_id"], r["src"], r["dst"], r["bond"]) for r in G.all_pairs(nodes, limit).collect())
    assert got == sorted((g, a, b, 0) for g, a in rows for h, b in rows if g == h and a != b)
    assert G.all_pairs(nodes.limit(0), limit).count() == 0
