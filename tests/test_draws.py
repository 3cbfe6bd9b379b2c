"""Draws from a histogram against a search in the whole running total."""

import bisect
import hashlib
import itertools

import pytest

from braidvec.operators import stats as T


@pytest.mark.parametrize("buckets", [1, 1024])
def test_draws_match_a_search_in_the_running_total(spark, monkeypatch, buckets):
    """A heavy size, gaps, and many rare sizes that share a bucket."""
    monkeypatch.setattr(T, "_BUCKETS", buckets)
    counts = {0: 0, 3: 100_000, 4: 0, **{k: 1 for k in range(10, 900)}, 1000: 50_000}
    histogram = spark.createDataFrame(list(counts.items()), "size long, cnt long")
    got = {r.draw_id: r["size"] for r in T.sample_sizes(spark.range(5000).toDF("draw_id"), histogram, 3).collect()}
    sizes = sorted(k for k, c in counts.items() if c)
    ends = list(itertools.accumulate(counts[k] for k in sizes))
    for d in range(5000):
        u = (int(hashlib.md5(f"3|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 * ends[-1]
        assert got[d] == sizes[bisect.bisect_right(ends, u)]


def test_running_totals_and_an_empty_histogram(spark):
    rows = spark.range(1000).selectExpr("1000 - id as size", "id % 5 as cnt").repartition(7)
    got = sorted((r["size"], r.lo, r.hi) for r in T.running_totals(rows, "size", "cnt").collect())
    ends = list(itertools.accumulate((1000 - s) % 5 for s in range(1, 1001)))
    assert got == [(s, ends[s - 1] - (1000 - s) % 5, ends[s - 1]) for s in range(1, 1001)]
    draws = spark.range(3).toDF("draw_id")
    assert [r["size"] for r in T.sample_sizes(draws, rows.limit(0), 1).collect()] == [None] * 3
