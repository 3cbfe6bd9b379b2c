"""Relational operators on node and edge tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.functions.hashing import hex_number, keyed_md5, unit_uniform
from braidvec.operators.cycles import short_cycles  # noqa: F401 (part of this module's interface)
from braidvec.operators.encode import GRAPH_LIMIT, nest_graphs
from braidvec.plans.skew import apart, few_keys, if_small, per_graph, safe_unions, split_large, together
from braidvec.session import cut_lineage

LANES = 4  # 32-bit pieces of an md5 digest that are summed to hash a multiset
MAX_ROUNDS = 64
# Nodes of one graph that a task pairs with all its nodes.
PAIR_NODES = 2000


# ---------------------------------------------------------------- edges and degrees


def double_edges(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, keeping repeats."""
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped)


def symmetrize(edges: DataFrame, allow_self_loops: bool = False) -> DataFrame:
    """Distinct edges in both directions."""
    pairs = edges.select("graph_id", "src", "dst")
    if not allow_self_loops:
        pairs = pairs.filter("src <> dst")
    return double_edges(pairs).distinct()


def check_symmetric(edges: DataFrame) -> DataFrame:
    """Edges (no loops) whose reverse is missing; empty for an undirected graph."""
    pairs = edges.select("graph_id", "src", "dst").filter("src <> dst").distinct()
    reverse = pairs.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(reverse, ["graph_id", "src", "dst"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree), zero for nodes without edges."""
    counts = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    joined = nodes.select("graph_id", "node_id").join(counts, ["graph_id", "node_id"], "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0)))


def residual_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Target degree (feat[1] + 1) minus current degree."""
    now = degrees(nodes, edges)
    joined = nodes.select("graph_id", "node_id", "feat").join(now, ["graph_id", "node_id"])
    return joined.select("graph_id", "node_id", (F.col("feat")[1] + 1 - F.col("degree")).cast("long").alias("residual"))


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can still take an edge."""
    return residual_degree(nodes, edges).filter("residual > 0")


def all_pairs(nodes: DataFrame, limit: int = PAIR_NODES) -> DataFrame:
    """Every ordered pair of different nodes of a graph, as class 0.

    A graph of more than ``limit`` nodes is cut into groups of about so many: its pairs are made by (graph, group of src), each by
    another task."""
    left = nodes.select("graph_id", F.col("node_id").alias("src"))
    right = nodes.select("graph_id", F.col("node_id").alias("dst"))
    wide = nodes.groupBy("graph_id").count().filter(F.col("count") > limit)
    large = few_keys(wide.select("graph_id", F.ceil(F.col("count") / limit).cast("int").alias("_n")))
    if large is None:
        out = left.join(right, "graph_id")
    else:
        safe_unions(nodes.sparkSession)
        small, _ = split_large(left, large.drop("_n"), ["graph_id"])
        one = left.join(large, "graph_id").withColumn("_g", F.pmod(F.xxhash64("src"), F.col("_n")).cast("int"))
        other = right.join(large, "graph_id").withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        met = apart(one.drop("_n"), "_g").join(apart(other.drop("_n"), "_g"), ["graph_id", "_g"]).drop("_g")
        out = small.join(right, "graph_id").unionByName(met)
    return out.filter("src <> dst").withColumn("bond", F.lit(0))


def edges_from_classes(pairs: DataFrame) -> DataFrame:
    """Edge rows from classed pairs: upper triangle, class above 0, mirrored."""
    upper = pairs.filter("src < dst AND bond > 0").select("graph_id", "src", "dst", "bond")
    return double_edges(upper)


def filter_graphs(
    nodes: DataFrame,
    edges: DataFrame,
    min_nodes: int | None = None,
    max_nodes: int | None = None,
    allowed: Sequence[int] | None = None,
    require_edges: bool = False,
) -> DataFrame:
    """graph_ids that pass the size limits, hold only allowed first features, and (optionally) have an edge."""
    banned = F.lit(0) if allowed is None else F.when(F.col("feat")[0].isin(list(allowed)), 0).otherwise(1)
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.max(banned).alias("banned"))
    keep = F.col("banned") == 0
    if min_nodes is not None:
        keep = keep & (F.col("n") >= min_nodes)
    if max_nodes is not None:
        keep = keep & (F.col("n") <= max_nodes)
    out = sizes.filter(keep).select("graph_id", "n")
    return out.join(edges.select("graph_id").distinct(), "graph_id", "left_semi") if require_edges else out


# ---------------------------------------------------------------- profiles and counts


def feature_counts(nodes: DataFrame) -> DataFrame:
    """How often each tuple occurs in each graph."""
    return nodes.groupBy("graph_id", "feat").agg(F.count("*").alias("cnt"))


def profile_nodes(nodes: DataFrame) -> DataFrame:
    """Distinct tuples of the whole collection."""
    return nodes.select("feat").distinct()


def with_end_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the tuples of both ends, fu and fv."""
    source = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("feat").alias("fu"))
    target = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("feat").alias("fv"))
    return edges.join(source, ["graph_id", "src"]).join(target, ["graph_id", "dst"])


def profile_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs of tuples joined by an edge, smaller tuple first."""
    pair = F.array_sort(F.array("fu", "fv"))
    ends = with_end_features(nodes, edges).select(pair.alias("p")).distinct()
    return ends.select(F.col("p")[0].alias("fu"), F.col("p")[1].alias("fv"))


def ring_sizes(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """Distinct (graph_id, node_id, feat, size) for ring sizes 3 to 20."""
    sizes = rings.filter("size BETWEEN 3 AND 20").select("graph_id", "node_id", "size").distinct()
    return nodes.select("graph_id", "node_id", "feat").join(sizes, ["graph_id", "node_id"])


def ring_histogram(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """Number of nodes per tuple and ring size."""
    return ring_sizes(nodes, rings).groupBy("feat", "size").agg(F.count("*").alias("cnt"))


def single_ring_features(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """Tuples for which no ring node lies in a graph where that tuple is in rings of several sizes."""
    members = nodes.select("graph_id", "node_id", "feat").join(
        rings.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"]
    )
    per_node = ring_sizes(nodes, rings).groupBy("graph_id", "node_id").agg(F.count("*").alias("sizes"))
    counted = members.join(per_node, ["graph_id", "node_id"], "left")
    per_graph_feat = counted.groupBy("graph_id", "feat").agg(F.max(F.coalesce("sizes", F.lit(0))).alias("most"))
    return per_graph_feat.groupBy("feat").agg(F.max("most").alias("most")).filter("most <= 1").select("feat")


def multiset_minus(full: DataFrame, part: DataFrame, keys: Sequence[str] = ("graph_id", "feat")) -> DataFrame:
    """Positive remainder of two count tables."""
    taken = part.select(*keys, F.col("cnt").alias("_taken"))
    left = full.join(taken, list(keys), "left").withColumn("cnt", F.col("cnt") - F.coalesce("_taken", F.lit(0)))
    return left.filter("cnt > 0").select(*keys, "cnt")


def order_leftovers(counts: DataFrame) -> DataFrame:
    """Distinct leftover tuples of each graph, ranked by degree and then by tuple."""
    window = Window.partitionBy("graph_id").orderBy(F.col("feat")[1], "feat")
    # At most one row per codebook tuple and graph.
    return counts.select("graph_id", "feat").distinct().withColumn("rank", F.row_number().over(window))


def contains_multiset(patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """Necessary test for an induced subgraph, for (pattern_id, target_id, feat, cnt) against (graph_id, feat, cnt)."""
    wanted = patterns.select("pattern_id", "target_id", "feat", F.col("cnt").alias("need"))
    have = targets.select(F.col("graph_id").alias("target_id"), "feat", F.col("cnt").alias("have"))
    joined = wanted.join(have, ["target_id", "feat"], "left")
    return joined.groupBy("pattern_id", "target_id").agg(
        F.bool_and(F.coalesce("have", F.lit(0)) >= F.col("need")).alias("contained")
    )


def edges_from_degrees(counts: DataFrame) -> DataFrame:
    """Number of undirected edges that the tuples imply: Σ degree · count div 2."""
    total = F.sum((F.col("feat")[1] + 1) * F.col("cnt"))
    return counts.groupBy("graph_id").agg(F.floor(total / 2).cast("long").alias("n_edges"))


def valence_deficit(nodes: DataFrame, edges: DataFrame, valences: DataFrame) -> DataFrame:
    """Target valence − charge − hydrogens − sum of bond orders per node; ``over`` marks over-valent nodes.

    ``valences`` is a small rule table (kind, valence): a fixed handful of rows."""
    order = F.when(F.col("bond") == 4, 1.5).otherwise(F.col("bond").cast("double"))
    used = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum(order).alias("used"))
    charge = F.when(F.col("feat")[2] == 1, 1).when(F.col("feat")[2] == 2, -1).otherwise(0)
    table = if_small(valences.select(F.col("kind").alias("_kind"), "valence"))
    joined = nodes.join(table, nodes["feat"][0] == table["_kind"], "left").join(used, ["graph_id", "node_id"], "left")
    target = F.coalesce("valence", F.lit(4)) - charge - F.col("feat")[3]
    deficit = (target - F.coalesce("used", F.lit(0.0))).alias("deficit")
    return joined.select("graph_id", "node_id", deficit).withColumn("over", F.col("deficit") < 0)


# ---------------------------------------------------------------- structural hashes


def _spread_edges(nodes: DataFrame, edges: DataFrame, whole: bool) -> DataFrame:
    """Edges plus one 'stay' row per node, so that a round is one join and one aggregate over a single chain.

    The union is dealt out once, by graph or (large graphs) by source node; all rounds read that exchange."""
    moves = edges.select("graph_id", "src", "dst", F.lit(False).alias("stay"))
    stays = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(True).alias("stay"))
    both = moves.unionByName(stays)
    return together(both) if whole else apart(both, "src")


def lanes_of(digest: Column) -> list[Column]:
    """Four 32-bit numbers of a digest; their sums over a multiset hash it without collecting or sorting it."""
    return [hex_number(digest, 1 + 8 * i, 8) for i in range(LANES)]


def label_number(lanes: Sequence[Column]) -> Column:
    """The first 52 bits of the digest that the lanes come from."""
    return lanes[0] * F.lit(1 << 20) + F.shiftright(lanes[1], 12)


def wl_labels(nodes: DataFrame, edges: DataFrame, iters: int = 3, keep_rounds: bool = False, whole: bool = True) -> DataFrame:
    """Neighbourhood labels after ``iters`` rounds: (graph_id, node_id, w0..w3), the lanes of the last digest.

    A round hashes a node's own lanes with the summed lanes of its neighbours. Labels travel as numbers, so that joins
    and aggregates stay in hash-based generated code; text exists only inside the md5 call. With ``keep_rounds`` the
    columns l0, l1, ... hold the label number of every round."""
    spread = _spread_edges(nodes, edges, whole)
    lanes = [f"w{i}" for i in range(LANES)]
    digest = F.md5(F.concat_ws(",", F.col("feat").cast("array<string>")))

    def cut(df: DataFrame, r: int, past: list[str]) -> DataFrame:
        out = df.select("graph_id", "node_id", *past, *[c.alias(n) for c, n in zip(lanes_of(F.col("_d")), lanes, strict=True)])
        return out.withColumn(f"l{r}", label_number([F.col(n) for n in lanes])) if keep_rounds else out

    past: list[str] = []
    state = cut(nodes.select("graph_id", "node_id", digest.alias("_d")), 0, past)
    for r in range(iters):
        past = [f"l{i}" for i in range(r + 1)] if keep_rounds else []
        sent = state.withColumnRenamed("node_id", "src").join(spread, ["graph_id", "src"])
        own = [F.max(F.when(F.col("stay"), F.col(c))).alias(c) for c in [*past, *lanes]]
        sums = [F.sum(F.when(~F.col("stay"), F.col(c))).alias(f"_{c}") for c in lanes]
        gathered = sent.groupBy("graph_id", F.col("dst").alias("node_id")).agg(*own, *sums)
        around = [F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in lanes]
        state = cut(gathered.withColumn("_d", keyed_md5(*[F.col(c) for c in lanes], *around)), r + 1, past)
    return state


def _digest_lanes(texts: list[str]) -> np.ndarray:
    """Lanes of the md5 of every text, as ``lanes_of`` reads them."""
    return np.frombuffer(b"".join([hashlib.md5(x.encode()).digest() for x in texts]), ">u4").reshape(-1, 4)[:, :LANES].astype(np.int64)


def _joined(values: np.ndarray) -> list[str]:
    """The numbers of every row as ``keyed_md5`` joins them."""
    form = "|".join(["%d"] * values.shape[1])
    return [form % tuple(row) for row in values.tolist()]


def _wl_task(iters: int):
    """Structural hash, nodes and directed edges of nested graphs: the rounds of ``wl_labels`` on all graphs of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.chunks(batch, 2 * LANES):
                flat = B.flatten_graphs(piece)
                texts = pa.array(flat.node["text"], pa.string()).dictionary_encode()
                lanes = _digest_lanes(texts.dictionary.to_pylist())[texts.indices.to_numpy()]
                for _ in range(iters):
                    around = B.segment_sum(lanes[flat.src], flat.dst, len(lanes))
                    lanes = _digest_lanes(_joined(np.concatenate([lanes, around], axis=1)))
                n = np.bincount(flat.graph_of_node, minlength=flat.count)
                sums = B.segment_sum(lanes, flat.graph_of_node, flat.count)
                wl = [hashlib.md5(x.encode()).hexdigest() for x in _joined(np.concatenate([n[:, None], sums], axis=1))]
                m = np.bincount(flat.graph_of_edge, minlength=flat.count)
                yield pa.RecordBatch.from_arrays([piece.column("graph_id"), pa.array(wl, pa.string()), pa.array(n), pa.array(m)], ["graph_id", "wl", "n", "_m"])

    return run


def _hashes(nodes: DataFrame, edges: DataFrame, iters: int, sizes: DataFrame | None) -> DataFrame:
    """(graph_id, wl, n, _m) with _m directed edges."""

    def job(n: DataFrame, e: DataFrame, whole: bool) -> DataFrame:
        if whole:
            # The text of a node is made after the exchange, and hashed in the task.
            text = n.select("graph_id", "node_id", F.concat_ws(",", F.col("feat").cast("array<string>")).alias("text"))
            kind = n.schema["graph_id"].dataType.simpleString()
            return nest_graphs(text, e, ["text"], []).mapInArrow(_wl_task(iters), f"graph_id {kind}, wl string, n long, _m long")
        labels = wl_labels(n, e, iters, whole=whole)
        sums = [F.sum(f"w{i}").alias(f"_s{i}") for i in range(LANES)]
        grouped = labels.groupBy("graph_id").agg(F.count("*").alias("n"), *sums)
        hashed = grouped.select("graph_id", keyed_md5(F.col("n"), *[F.col(f"_s{i}") for i in range(LANES)]).alias("wl"), "n")
        counts = e.groupBy("graph_id").agg(F.count("*").alias("_m"))
        return hashed.join(counts, "graph_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))

    return per_graph(nodes.select("graph_id", "node_id", "feat"), edges.select("graph_id", "src", "dst"), job, GRAPH_LIMIT, sizes)


def wl_hash(nodes: DataFrame, edges: DataFrame, iters: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Structural hash of each graph: (graph_id, wl, n)."""
    return _hashes(nodes, edges, iters, sizes).drop("_m")


def graph_hash(nodes: DataFrame, edges: DataFrame, iters: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """(graph_id, wl, n, m) with m undirected edges. ``sizes`` may hold the graphs' ``graph_sizes``."""
    return _hashes(nodes, edges, iters, sizes).select("graph_id", "wl", "n", F.floor(F.col("_m") / 2).cast("long").alias("m"))


def dedup_graphs(hashes: DataFrame) -> DataFrame:
    """First graph_id of each (wl, n, m); a minimum is combined map-side, so many copies of one graph are harmless."""
    return hashes.groupBy("wl", "n", "m").agg(F.min("graph_id").alias("graph_id"), F.count("*").alias("copies"))


def isomorphic_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of graphs of two sets that agree in hash, n and m (necessary for isomorphism).

    Pairs are kept factored, one row per key with the number of graphs and the first id on each side: the pairs of a
    frequent structure are never written out. Use ``isomorphic_match`` to flag given pairs."""
    keys = ["wl", "n", "m"]
    left = a.groupBy(*keys).agg(F.count("*").alias("n_a"), F.min("graph_id").alias("first_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("n_b"), F.min("graph_id").alias("first_b"))
    return left.join(right, keys).withColumn("n_pairs", F.col("n_a") * F.col("n_b"))


def isomorphic_match(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Flag given (a, b) pairs of graph ids that agree in hash, n and m."""
    key = F.struct("wl", "n", "m")
    left = hashes.select(F.col("graph_id").alias("a"), key.alias("_ka"))
    right = hashes.select(F.col("graph_id").alias("b"), key.alias("_kb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.withColumn("candidate", F.coalesce(F.col("_ka") == F.col("_kb"), F.lit(False))).drop("_ka", "_kb")


# ---------------------------------------------------------------- components


def _component_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = B.flatten_graphs(batch)
        root = B.component_labels(flat)
        ids = flat.node["node_id"]
        # Report the smallest node_id of the component, whatever the order of the list.
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, root, ids.astype(np.int64))
        graph = batch.column("graph_id").to_numpy(zero_copy_only=False)[flat.graph_of_node]
        columns = [pa.array(graph), pa.array(ids), pa.array(lowest[root].astype(np.int32), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["graph_id", "node_id", "label"])


def _components_spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds: every task handles a share of the edges of one graph."""
    star = symmetrize(edges).filter("src > dst").select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    star = cut_lineage(star)
    swap = lambda df: df.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))
    key = F.xxhash64("graph_id", "u", "v").cast("decimal(38,0)")
    before = None
    for _ in range(MAX_ROUNDS):
        around = star.unionByName(swap(star))
        least = around.groupBy("graph_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, ["graph_id", "u"]).filter("v > u").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        least = large.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        down = large.join(least, ["graph_id", "u"]).filter("v <> m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut_lineage(down.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct())
        now = star.agg(F.count("*"), F.sum(key)).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = star.select("graph_id", F.col("u").alias("node_id"), F.col("v").alias("label"))
    joined = nodes.select("graph_id", "node_id").join(roots, ["graph_id", "node_id"], "left")
    return joined.withColumn("label", F.coalesce("label", "node_id"))


def components(nodes: DataFrame, edges: DataFrame, limit: int = GRAPH_LIMIT) -> DataFrame:
    """(graph_id, node_id, label): smallest node_id of each node's component."""

    def job(n: DataFrame, e: DataFrame, together: bool) -> DataFrame:
        if not together:
            return _components_spread(n, e)
        return nest_graphs(n, e, [], []).mapInArrow(_component_batches, "graph_id long, node_id int, label int")

    n = nodes.select("graph_id", F.col("node_id").cast("int").alias("node_id"))
    e = edges.select("graph_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    return per_graph(n, e, job, limit)


def is_valid_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_components, n_loops, valid): connected and free of self-loops."""
    # A component counts once, at the node that names it: no distinct count over the labels of a large graph.
    parts = components(nodes, edges).groupBy("graph_id").agg(F.count_if(F.col("label") == F.col("node_id")).alias("n_components"))
    loops = edges.filter("src = dst").groupBy("graph_id").agg(F.count("*").alias("n_loops"))
    joined = parts.join(loops, "graph_id", "left").withColumn("n_loops", F.coalesce("n_loops", F.lit(0)))
    return joined.withColumn("valid", (F.col("n_components") == 1) & (F.col("n_loops") == 0))


def cyclomatic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ring count m − n + components, for undirected edges stored in both directions."""
    parts = components(nodes, edges).groupBy("graph_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("node_id")).alias("c")
    )
    m = edges.groupBy("graph_id").agg(F.floor(F.count("*") / 2).cast("long").alias("m"))
    joined = parts.join(m, "graph_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return joined.withColumn("rings", F.col("m") - F.col("n") + F.col("c"))


# ---------------------------------------------------------------- centrality


def _pagerank_job(damping: float, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = B.flatten_graphs(batch)
            graph = batch.column("graph_id").to_numpy(zero_copy_only=False)[flat.graph_of_node]
            columns = [pa.array(graph), pa.array(flat.node["node_id"]), pa.array(B.pagerank_values(flat, damping, rounds))]
            yield pa.RecordBatch.from_arrays(columns, ["graph_id", "node_id", "pagerank"])

    return run


def _pagerank_spread(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    degree = degrees(nodes, edges)
    sizes = degree.groupBy("graph_id").agg(F.count("*").alias("size"), F.count_if(F.col("degree") == 0).alias("loose"))
    # Isolated nodes all carry the same rank, so their total follows from one number per row.
    state = cut_lineage(degree.join(sizes, "graph_id").withColumns({"pagerank": 1.0 / F.col("size"), "lone": 1.0 / F.col("size")}))
    for r in range(rounds):
        sent = state.select("graph_id", F.col("node_id").alias("src"), (F.col("pagerank") / F.col("degree")).alias("share"))
        got = edges.join(sent, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("share").alias("got"))
        base = (1 - damping) / F.col("size") + damping * F.col("loose") * F.col("lone") / F.col("size")
        joined = state.join(got, ["graph_id", "node_id"], "left")
        state = joined.withColumns({"pagerank": base + damping * F.coalesce("got", F.lit(0.0)), "lone": base}).drop("got")
        if r % 4 == 3:
            state = cut_lineage(state)
    return state.select("graph_id", "node_id", "pagerank")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, limit: int = GRAPH_LIMIT) -> DataFrame:
    """PageRank of every node inside its graph."""

    def job(n: DataFrame, e: DataFrame, together: bool) -> DataFrame:
        if not together:
            return _pagerank_spread(n, e, damping, rounds)
        return nest_graphs(n, e, [], []).mapInArrow(_pagerank_job(damping, rounds), "graph_id long, node_id int, pagerank double")

    return per_graph(nodes.select("graph_id", "node_id"), edges.select("graph_id", "src", "dst"), job, limit)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degree / (n − 1); 1 for a single node."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    joined = degrees(nodes, edges).join(sizes, "graph_id")
    value = F.when(F.col("n") <= 1, 1.0).otherwise(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)))
    return joined.select("graph_id", "node_id", value.alias("centrality"))


# ---------------------------------------------------------------- supply


def composition_grid(spark: SparkSession, symbols: Sequence[str], n_min: int, n_max: int, require: str) -> DataFrame:
    """All count vectors over the symbols with a sum in [n_min, n_max] and at least one of ``require``.

    Grown symbol by symbol: each partial vector is exploded into the counts that still fit, so no vector is made and
    then thrown away."""
    grid = spark.range(n_min, n_max + 1).select(F.col("id").cast("int").alias("total"), F.col("id").cast("int").alias("_left"))
    for symbol in symbols[:-1]:
        least = F.lit(1 if symbol == require else 0)
        fits = F.when(F.col("_left") >= least, F.sequence(least, F.col("_left"))).otherwise(F.array().cast("array<int>"))
        grid = grid.withColumn(symbol, F.explode(fits)).withColumn("_left", F.col("_left") - F.col(symbol))
    grid = grid.withColumnRenamed("_left", symbols[-1])
    return grid.filter(F.col(symbols[-1]) >= 1) if symbols[-1] == require else grid


def draw_class(probabilities: Column, u: Column, classes: int) -> Column:
    """First class whose cumulative probability exceeds u."""
    out, total = F.lit(classes - 1), F.lit(0.0)
    branches = []
    for c in range(classes):
        total = total + probabilities[c]
        branches.append((total, c))
    for bound, c in reversed(branches[:-1]):
        out = F.when(u < bound, c).otherwise(out)
    return out


def noise_edges(nodes: DataFrame, edges: DataFrame, marginals: DataFrame, t: float, seed: int, classes: int = 5) -> DataFrame:
    """Noisy bond classes: per unordered pair draw from t·onehot + (1−t)·marginal[size], then mirror.

    ``marginals`` has one row per size (bounded by the largest size in the table): (size, probs array)."""
    top = marginals.agg(F.max("size")).first()[0]
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    upper = all_pairs(nodes).filter("src < dst").drop("bond")
    true = edges.filter("src < dst").groupBy("graph_id", "src", "dst").agg(F.max("bond").alias("bond"))
    joined = upper.join(true, ["graph_id", "src", "dst"], "left").withColumn("bond", F.coalesce("bond", F.lit(0)))
    joined = joined.join(sizes, "graph_id").withColumn("size", F.least(F.col("n"), F.lit(top)))
    joined = joined.join(if_small(marginals.select("size", "probs")), "size")
    probs = F.array(
        *[F.lit(t) * F.when(F.col("bond") == c, 1.0).otherwise(0.0) + F.lit(1 - t) * F.col("probs")[c] for c in range(classes)]
    )
    u = unit_uniform(keyed_md5(seed, F.col("graph_id"), F.col("src"), F.col("dst")))
    drawn = joined.select("graph_id", "src", "dst", draw_class(probs, u, classes).alias("bond"))
    return double_edges(drawn)
