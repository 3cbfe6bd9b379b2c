"""Random-walk return probabilities and the features made from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.functions.features import bin_walk
from braidvec.operators.encode import nest_graphs
from braidvec.operators.graphs import symmetrize
from braidvec.plans.skew import apart, order_statistics, per_graph
from braidvec.schema import WalkConfig
from braidvec.session import cut_lineage


# Graphs up to this many nodes and edges together use stacked dense matrices; larger ones use joins.
WALK_LIMIT = 1024


def _halves(k: int) -> tuple[int, int]:
    return (k + 1) // 2, k // 2


def rw_return_wide(nodes: DataFrame, edges: DataFrame, ks: Sequence[int], limit: int = WALK_LIMIT) -> DataFrame:
    """(graph_id, node_id, rw array<double>): diagonal of (D⁻¹A)^k for each k; 1.0 for a node without edges.

    Ordinary graphs are brought together once and multiplied as stacks of dense matrices. Large graphs use joins. There,
    a walk on an undirected graph is reversible, P^b(u,v) = P^b(v,u)·d(v)/d(u), so the return probability after
    k = a + b steps is Σ_u P^a(v,u)·P^b(v,u)·d(v)/d(u). That needs walks of ⌈k/2⌉ steps only: half the rounds, and rows
    only for the ball of half the radius. All walk lengths share one chain of rounds."""
    rounds = max(_halves(max(ks))[0], 1)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = B.flatten_graphs(batch)
            graph = batch.column("graph_id").to_numpy(zero_copy_only=False)[flat.graph_of_node]
            values = B.vector_column(B.return_probabilities(flat, list(ks)))
            yield pa.RecordBatch.from_arrays([pa.array(graph), pa.array(flat.node["node_id"]), values], ["graph_id", "node_id", "rw"])

    def job(n: DataFrame, e: DataFrame, together: bool) -> DataFrame:
        if together and min(ks) > 0:
            return nest_graphs(n, e, [], []).mapInArrow(dense, "graph_id long, node_id int, rw array<double>")
        pairs = symmetrize(e, allow_self_loops=True)
        degree = pairs.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").cast("double").alias("deg"))
        known = n.join(degree, ["graph_id", "node_id"], "left").withColumn("deg", F.coalesce("deg", F.lit(0.0)))
        ends = known.select("graph_id", F.col("node_id").alias("dst"), F.col("deg").alias("ddeg"))
        moves = pairs.join(ends, ["graph_id", "dst"]).select("graph_id", "src", "dst", "ddeg", F.lit(False).alias("stay"))
        stays = known.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("deg").alias("ddeg"), F.lit(True).alias("stay"))
        spread = apart(moves.unionByName(stays), "src")
        walk = known.select("graph_id", F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.col("deg").alias("sdeg"), F.col("deg").alias("adeg"), F.lit(1.0).alias("p0"))
        for step in range(1, rounds + 1):
            joined = walk.withColumnRenamed("at", "src").join(spread, ["graph_id", "src"])
            kept = [F.sum(F.when(F.col("stay"), F.col(f"p{j}")).otherwise(0.0)).alias(f"p{j}") for j in range(step)]
            moved = F.sum(F.when(F.col("stay"), 0.0).otherwise(F.col(f"p{step - 1}") / F.greatest("adeg", F.lit(1.0)))).alias(f"p{step}")
            walk = joined.groupBy("graph_id", "start", F.col("dst").alias("at"), "sdeg", F.col("ddeg").alias("_adeg")).agg(*kept, moved)
            walk = walk.withColumnRenamed("_adeg", "adeg")
        back = []
        for i, k in enumerate(ks):
            a, b = _halves(k)
            back.append(F.sum(F.col(f"p{a}") * F.col(f"p{b}") * F.col("sdeg") / F.greatest("adeg", F.lit(1.0))).alias(f"_r{i}"))
        sums = walk.groupBy("graph_id", F.col("start").alias("node_id"), "sdeg").agg(*back)
        values = [F.when(F.col("sdeg") == 0, 1.0).otherwise(F.col(f"_r{i}")) for i in range(len(ks))]
        return sums.select("graph_id", "node_id", F.array(*values).alias("rw"))

    return per_graph(nodes.select("graph_id", "node_id"), edges.select("graph_id", "src", "dst"), job, limit)


def rw_return(nodes: DataFrame, edges: DataFrame, ks: Sequence[int] = (3, 6), limit: int = WALK_LIMIT) -> DataFrame:
    """Long form: (graph_id, node_id, k, p)."""
    wide = rw_return_wide(nodes, edges, ks, limit)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col("rw")[i].alias("p")) for i, k in enumerate(ks)])
    return wide.select("graph_id", "node_id", F.explode(rows).alias("_r")).select("graph_id", "node_id", "_r.k", "_r.p")


def augment_rw(nodes: DataFrame, edges: DataFrame, walk: WalkConfig, limit: int = WALK_LIMIT) -> DataFrame:
    """Nodes with the walk bins appended to ``feat``."""
    wide = rw_return_wide(nodes, edges, walk.ks, limit)
    bins = F.array(*[bin_walk(F.col("rw")[i], k, walk) for i, k in enumerate(walk.ks)])
    joined = nodes.join(wide, ["graph_id", "node_id"])
    return joined.withColumn("feat", F.concat("feat", bins)).drop("rw")


def scan_rw(nodes: DataFrame, edges: DataFrame, walk: WalkConfig) -> DataFrame:
    """Distinct tuples with walk bins that occur in the collection."""
    return augment_rw(nodes, edges, walk).select("feat").distinct()


def fit_quantile_bounds(probs: DataFrame, num_bins: int) -> DataFrame:
    """Equal-frequency boundaries per walk length from (k, p) rows, rounded to six decimals: (k, bounds).

    One exact selection per walk length; the result is one small row for each."""
    counts = cut_lineage(probs.groupBy("k", "p").agg(F.count("*").alias("_c")))
    ks = sorted(r["k"] for r in counts.select("k").distinct().collect())
    shares = [i / num_bins for i in range(1, num_bins)]
    rows = []
    for k in ks:
        _, bounds = order_statistics(counts.filter(F.col("k") == k), "p", shares, weight="_c")
        rows.append((k, [round(b, 6) for b in bounds]))
    return probs.sparkSession.createDataFrame(rows, "k int, bounds array<double>")


def preset_bounds(presets: Mapping[int, Mapping[int, Sequence[float]]], num_bins: int) -> Mapping[int, Sequence[float]]:
    """Boundaries of a prepared table {num_bins: {k: bounds}}; an unknown bin count raises and lists the known ones."""
    if num_bins not in presets:
        raise ValueError(f"no boundaries for num_bins={num_bins}; available: {sorted(presets)}")
    return presets[num_bins]


def fit_presets(probs: DataFrame, counts: Sequence[int] = (3, 4, 5, 6, 7)) -> dict[int, dict[int, tuple[float, ...]]]:
    """Preset table for several bin counts; one small row per walk length and bin count reaches the driver."""
    out, probs = {}, cut_lineage(probs.select("k", "p"))
    for n in counts:
        rows = fit_quantile_bounds(probs, n).collect()
        out[n] = {row["k"]: tuple(row["bounds"]) for row in rows}
    return out


def rw_profile(probs: DataFrame, bounds: Mapping[int, Sequence[float]], group: str | None = None) -> DataFrame:
    """Per group, k and bin: mean, population std, min, max of the values and the share that lies in the bin.

    Bins lie between 0, the boundaries of k, and 1. A bin of no width holds the values equal to its edge; the last bin
    holds everything from its lower edge upwards."""
    keys = ([group] if group else []) + ["k"]
    width = max(len(b) for b in bounds.values()) + 1
    shares = []
    for number in range(width):
        inside = F.lit(None).cast("boolean")
        for k, inner in bounds.items():
            edges = [0.0, *inner, 1.0]
            if number >= len(edges) - 1:
                continue
            lo, hi = edges[number], edges[number + 1]
            if number == len(edges) - 2:
                test = F.col("p") >= lo
            else:
                test = (F.col("p") >= lo) & (F.col("p") < hi) if lo < hi else F.col("p") == lo
            inside = F.when(F.col("k") == k, test).otherwise(inside)
        shares.append(F.avg(inside.cast("int")).alias(f"bin{number}"))
    stats = [F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max")]
    return probs.groupBy(*keys).agg(*stats, *shares)
