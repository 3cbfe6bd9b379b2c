"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors and queries are laid out on a grid: a cell holds one range of the vectors and one block of the queries, both of bounded
size, so any number of queries is answered without sending them to every task. In a cell, every dimension has a list of the
vectors sorted by that component. The lists are read from the end that suits the sign of each query's component; vectors met on
the way are scored in full, and a query stops when the sum of its components times the values reached cannot beat (or tie with)
its kth score. Cells keep k rows a query, and a last aggregation keeps the k best of those.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do rows without an id. Vectors of another length than the query have no score with it. Ties go to the smaller
id. Rows repeated whole count once; of several vectors with one id, the smallest (compared element by element) counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_VECTORS = 1 << 15  # vectors in a cell, about
CELL_QUERIES = 1 << 11  # queries in a cell, about
_DEPTH = 256  # positions of each list that are read in the first round; doubled in every further round


def usable(vector: str) -> Column:
    """Whether a vector has components and all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def threshold_top_k(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of the k best of ``vectors`` for every query, by score descending and id ascending.

    ``own`` is the id that a query leaves out. Numbers are integers held as floats; sums stay exact below 2**53.
    """
    n, dims = vectors.shape
    lists = np.argsort(vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, lists, 0)
    open_queries = np.arange(len(queries))
    seen = np.zeros(n, bool)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
    read, depth = 0, min(n, _DEPTH)
    while len(open_queries):
        # Sorted access: both ends, as queries of either sign share the lists. Random access: new vectors are scored in full.
        met = np.unique(np.concatenate([lists[read:depth].ravel(), lists[n - depth : n - read].ravel()]))
        new = met[~seen[met]]
        seen[new] = True
        if len(new):
            scores = queries[open_queries] @ vectors[new].T
            for row, q in enumerate(open_queries):
                s, i = scores[row], ids[new]
                kth = best[q][1][-1] if len(best[q][1]) == k else -np.inf
                keep = np.flatnonzero((s >= kth) & (i != own[q]))
                if len(keep) > 4 * k:  # enough to hold the k best and all ties with the kth
                    edge = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[s[keep] >= edge]
                i, s = np.concatenate([best[q][0], i[keep]]), np.concatenate([best[q][1], s[keep]])
                order = np.lexsort((i, -s))[:k]
                best[q] = i[order], s[order]
        if depth >= n:
            break
        # No unseen vector lies beyond the last position read of any list.
        q = queries[open_queries]
        bound = (np.where(q > 0, values[n - depth], values[depth - 1]) * q).sum(1)
        kth = np.array([best[j][1][-1] if len(best[j][1]) == k else -np.inf for j in open_queries])
        open_queries = open_queries[bound >= kth]
        read, depth = depth, min(n, 2 * depth)
    for row, (i, s) in enumerate(best):
        if len(i):
            yield row, i, s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, vec array<long>) and (query_id, vec array<long>), by integer inner product."""
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-n // cell_vectors)), max(1, -(-m // cell_queries))
    place = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    # Each vector goes to every block of queries, each query to every range of vectors: the least a grid can send.
    left = vectors.select("vec_id", "vec", place("vec_id", rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    right = queries.select("query_id", F.col("vec").alias("q"), place("query_id", columns).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, some in a.groupby(a["vec"].map(len)):
            asked = b[b["q"].map(len) == size]
            if len(asked):
                x, q = np.stack(some["vec"]).astype(float), np.stack(asked["q"]).astype(float)
                names = asked["query_id"].to_numpy()
                for row, i, s in threshold_top_k(x, some["vec_id"].to_numpy(), q, names, k):
                    out.append(pd.DataFrame({"query_id": names[row], "vec_id": i, "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * component) of every usable vector, one row an id."""
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return good.select("vec_id", whole.alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
