"""Chordless cycles by degree-ordered search.

Nodes are ranked by (degree, id). A cycle is grown from its lowest-ranked node s: first two neighbours of s of higher rank, then,
step by step, a further node of higher rank than s at the end of smaller degree. A new node that touches an inner node would make
a chord and ends the path; one that touches the other end closes a cycle. Every cycle has one such derivation. A node has at
most sqrt(2 * edges) neighbours of higher rank, and a hub is only walked through from an end of at least its degree, so a star or
a fan of triangles costs no more than its edges.

Ordinary graphs run in Arrow batches; graphs with many edges, or a large predicted work (the sum of squared degrees), stay spread
over the cluster, where neither the paths at one end nor the neighbours of one node come to one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.operators.encode import GRAPH_LIMIT
from braidvec.plans.skew import few_keys, if_small, split_large, together
from braidvec.session import cut_lineage

# Largest sum of squared degrees of a graph that one task searches.
WORK_LIMIT = 1 << 24
# Path steps that a task holds at once.
STEPS_AT_ONCE = 1 << 18
# Spread graphs: paths at one end, and neighbours of one node, that meet under one key (their product is one key's path steps).
PATHS_A_KEY = 1000
NEIGHBOURS_A_KEY = 1000


# ---------------------------------------------------------------- ordinary graphs


class _Batch:
    """Graphs of a batch with nodes renumbered by rank, neighbours in sorted lists."""

    def __init__(self, graph: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        graph, src, dst = (x[src != dst] for x in (graph, src, dst))
        low = min(src.min(initial=0), dst.min(initial=0))
        span = int(max(src.max(initial=0), dst.max(initial=0)) - low) + 1
        names, number = np.unique(np.concatenate([graph * span + (src - low), graph * span + (dst - low)]), return_inverse=True)
        self.n = max(len(names), 1)
        u, v = np.split(number, 2)
        pairs = np.unique(np.concatenate([u * self.n + v, v * self.n + u]))
        u, v = np.divmod(pairs, self.n)
        degree = np.bincount(u, minlength=self.n)
        order = np.lexsort((np.arange(self.n), degree))
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        self.pairs = np.sort(rank[u] * self.n + rank[v])
        self.source, self.near = np.divmod(self.pairs, self.n)
        self.degree = degree[order]
        self.begin = np.searchsorted(self.source, np.arange(self.n + 1))
        self.graph, self.id = np.divmod(names[order] if len(names) else np.zeros(1, np.int64), span)
        self.id += low

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return self.pairs[at] == key

    def wedges(self) -> Iterator[np.ndarray]:
        """(x, s, y) with s ranked below x and x below y."""
        up = np.flatnonzero(self.near > self.source)
        more = self.begin[self.source[up] + 1] - 1 - up
        for rows in _pieces(more):
            first = np.repeat(up[rows], more[rows])
            second = first + 1 + _counting(more[rows])
            yield np.stack([self.near[first], self.source[first], self.near[second]], 1)

    def steps(self, paths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Open paths longer by one node, and whether they close."""
        a, b = paths[:, 0], paths[:, -1]
        turn = (self.degree[a] < self.degree[b]) | ((self.degree[a] == self.degree[b]) & (a < b))
        paths = np.where(turn[:, None], paths[:, ::-1], paths)
        lowest, end = paths.min(1), paths[:, -1]
        for rows in _pieces(self.degree[end]):
            count = self.degree[end[rows]]
            row = np.repeat(rows, count)
            to = self.near[np.repeat(self.begin[end[rows]], count) + _counting(count)]
            keep = (to > lowest[row]) & (to != paths[row, -2])
            row, to = row[keep], to[keep]
            for c in range(1, paths.shape[1] - 1):
                apart = ~self.linked(paths[row, c], to)
                row, to = row[apart], to[apart]
            yield np.concatenate([paths[row], to[:, None]], 1), self.linked(paths[row, 0], to)

    def rings(self, max_len: int) -> Iterator[np.ndarray]:
        if not len(self.pairs):
            return
        for wedge in self.wedges():
            closed = self.linked(wedge[:, 0], wedge[:, 2])
            if closed.any():
                yield wedge[closed]
            waiting = [wedge[~closed]] if max_len > 3 else []
            while waiting:  # the longest first, so that few paths wait
                for longer, closed in self.steps(waiting.pop()):
                    if closed.any():
                        yield longer[closed]
                    if longer.shape[1] < max_len and not closed.all():
                        waiting.append(longer[~closed])


def _counting(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for every count c."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in pieces of about STEPS_AT_ONCE items."""
    total = np.cumsum(counts)
    cut = np.searchsorted(total, np.arange(STEPS_AT_ONCE, int(total[-1]) if len(total) else 0, STEPS_AT_ONCE), "right")
    yield from (piece for piece in np.split(np.arange(len(counts)), cut) if len(piece))


def _from_smallest(rings: np.ndarray) -> np.ndarray:
    """Each ring from its smallest node on, towards that one's smaller neighbour."""
    n = rings.shape[1]
    rings = np.take_along_axis(rings, (rings.argmin(1)[:, None] + np.arange(n)) % n, 1)
    back = rings[:, 1] > rings[:, -1]
    rings[back, 1:] = rings[back, 1:][:, ::-1]
    return rings


def _search(max_len: int, kind: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("edges").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for rows in _pieces(sizes):
                part = whole.slice(rows[0], len(rows))
                graph, edge = B._list_parts(part.column("edges"))
                flat = _Batch(graph, edge["src"].astype(np.int64), edge["dst"].astype(np.int64))
                for found in flat.rings(max_len):
                    path = _from_smallest(flat.id[found])
                    cuts = pa.array(np.arange(0, path.size + 1, path.shape[1]), pa.int32())
                    lists = pa.ListArray.from_arrays(cuts, pa.array(path.reshape(-1)).cast(kind))
                    yield pa.RecordBatch.from_arrays([part.column("graph_id").take(pa.array(flat.graph[found[:, 0]])), lists], ["graph_id", "path"])

    return task


def _cycles_together(edges: DataFrame, max_len: int) -> DataFrame:
    types = dict(edges.dtypes)
    kind = pa.int64() if types["src"] == "bigint" else pa.int32()
    lists = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))  # size-checked graphs
    return lists.mapInArrow(_search(max_len, kind), f"graph_id {types['graph_id']}, path array<{types['src']}>")


# ---------------------------------------------------------------- graphs that stay spread


def _nodes_at(name: str) -> Column:
    return F.col("path")[name] if isinstance(name, int) else F.element_at("path", -1)


def _bucket(value: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(value), parts)


def _cycles_spread(edges: DataFrame, max_len: int) -> DataFrame:
    """Paths as arrays of (degree, id), which sort by rank; every step is a join under keys of bounded size."""
    pairs = edges.filter("src <> dst").select("graph_id", "src", "dst")
    pairs = cut_lineage(pairs.unionByName(pairs.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = cut_lineage(pairs.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("d")))
    node = lambda c: degree.select("graph_id", F.col("id").alias(c), F.struct("d", "id").alias(f"_{c}"))
    ranked = cut_lineage(pairs.join(node("src"), ["graph_id", "src"]).join(node("dst"), ["graph_id", "dst"]).select("graph_id", F.col("_src").alias("u"), F.col("_dst").alias("v")))
    chunks = F.ceil(F.col("u.d") / NEIGHBOURS_A_KEY)
    near = ranked.select("graph_id", "u", "v", _bucket(F.col("v"), chunks).alias("chunk"))
    # Two neighbours above s: all pairs of chunks of s's list, each pair of chunks under a key of its own.
    up = near.filter("u < v")
    many = F.sequence(F.lit(0).cast("long"), chunks - 1)
    left = up.select("graph_id", F.col("u").alias("s"), F.col("v").alias("x"), F.col("chunk").alias("i"), F.explode(many).alias("j"))
    right = up.select("graph_id", F.col("u").alias("s"), F.col("v").alias("y"), F.col("chunk").alias("j"), F.explode(many).alias("i"))
    wedges = left.join(right, ["graph_id", "s", "i", "j"]).filter("x < y").select("graph_id", F.array("x", "s", "y").alias("path"))
    sides = ranked.select("graph_id", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(True).alias("linked"))
    ends = wedges.select("graph_id", "path", _nodes_at(0).alias("x"), _nodes_at("last").alias("y"))
    marked = cut_lineage(ends.join(sides, ["graph_id", "x", "y"], "left").select("graph_id", "path", F.col("linked").isNotNull().alias("closed")))
    found = marked.filter("closed").select("graph_id", "path")
    paths = marked.filter("NOT closed").select("graph_id", "path")
    for _ in range(4, max_len + 1):
        a, b = _nodes_at(0), _nodes_at("last")
        turned = paths.select("graph_id", F.when(a < b, F.reverse("path")).otherwise(F.col("path")).alias("path"))
        at = turned.withColumn("u", _nodes_at("last"))
        counts = at.groupBy("graph_id", "u").agg(F.count("*").alias("n")).filter(F.col("n") > PATHS_A_KEY)
        hot = if_small(cut_lineage(counts.select("graph_id", "u", F.ceil(F.col("n") / PATHS_A_KEY).alias("salts"))))
        salts = F.coalesce("salts", F.lit(1))
        asked = at.join(hot, ["graph_id", "u"], "left").select("graph_id", "u", "path", _bucket(F.col("path"), salts).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        lists = near.join(hot, ["graph_id", "u"], "left").select("graph_id", "u", "v", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        grown = asked.join(lists, ["graph_id", "u", "chunk", "salt"])
        grown = cut_lineage(grown.filter((F.col("v") > F.array_min("path")) & (F.col("v") != F.element_at("path", -2))).select("graph_id", "path", F.col("v").alias("to")))
        probes = grown.select("graph_id", "path", "to", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("place", "u"))
        hits = probes.join(ranked.select("graph_id", "u", F.col("v").alias("to")), ["graph_id", "u", "to"], "left_semi")
        facts = hits.groupBy("graph_id", "path", "to").agg(F.max("place").alias("inner"))
        judged = grown.join(facts, ["graph_id", "path", "to"], "left").filter("coalesce(inner, 0) = 0")
        longer = judged.select("graph_id", F.concat("path", F.array("to")).alias("path"), F.col("inner").isNotNull().alias("closed"))
        marked = cut_lineage(longer)
        found = found.unionByName(marked.filter("closed").select("graph_id", "path"))
        paths = marked.filter("NOT closed").select("graph_id", "path")
    ids = found.select("graph_id", F.transform("path", lambda x: x["id"]).alias("path"))
    first = F.array_position("path", F.array_min("path")).cast("int")
    rolled = ids.select("graph_id", F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1)).alias("path"))
    back = F.concat(F.slice("path", F.lit(1), F.lit(1)), F.reverse(F.slice("path", F.lit(2), F.size("path"))))
    return rolled.select("graph_id", F.when(_nodes_at(1) > _nodes_at("last"), back).otherwise(F.col("path")).alias("path"))


def short_cycles(edges: DataFrame, max_len: int = 6, limit: int = GRAPH_LIMIT, work_limit: int = WORK_LIMIT) -> DataFrame:
    """Members of chordless cycles of 3 to ``max_len`` nodes: (graph_id, ring_id, node_id, size).

    ``ring_id`` names the cycle's nodes from the smallest one on, towards its smaller neighbour."""
    if max_len < 3:
        raise ValueError("max_len must be at least 3")
    edges = edges.select("graph_id", "src", "dst")
    by_node = edges.groupBy("graph_id", "src").agg(F.count("*").alias("d"))
    work = by_node.groupBy("graph_id").agg(F.sum("d").alias("size"), F.sum(F.col("d") * F.col("d")).alias("work"))
    large = few_keys(work.filter((F.col("size") > limit) | (F.col("work") > work_limit)).select("graph_id"))
    small_edges, large_edges = split_large(edges, large, ["graph_id"])
    found = _cycles_together(together(small_edges), max_len)
    if large_edges is not None:
        found = found.unionByName(_cycles_spread(large_edges, max_len))
    ring_id = F.concat_ws("-", F.col("path").cast("array<string>"))
    return found.select("graph_id", ring_id.alias("ring_id"), F.size("path").alias("size"), F.explode("path").alias("node_id"))
