"""Encoding graphs into hypervectors.

Order-0 and order-1 terms depend on a graph only through how often each tuple, or pair of tuples, occurs. Every task counts its
own rows and sends counts, or a vector where that is shorter, so no task ever holds the nodes of a large graph. Deeper encodings bring each ordinary graph
together once by graph_id and run all layers there on Arrow batches; graphs above the size limit take the join path, where
every layer is a join and a pre-aggregated element-wise sum spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.functions import vsa as V
from braidvec.operators.bundling import bundle, rows_of, sum_counted
from braidvec.operators.codebook import Codebook, make_codebook, named_rows, with_index
from braidvec.plans.skew import GROUP_LIMIT, per_graph
from braidvec.schema import EncoderConfig
from braidvec.session import cut_lineage

# A graph is encoded in one task only up to this many nodes and edges together.
GRAPH_LIMIT = 20_000


def _vector_type(vsa: str) -> str:
    return V.COMPLEX_TYPE if vsa == "FHRR" else "array<double>"


def _finish_column(hv: Column, vsa: str) -> Column:
    return V.from_spectral(hv) if vsa == "HRR" else hv


def _sum_of_counts(counts: DataFrame, key: str, codebook: Codebook, out: str, pairs: bool, then: tuple | None = None, parts: int = 0) -> DataFrame:
    """Σ count · vector per key from rows (key, idx, cnt), or Σ count · bind from rows (key, a, b, cnt); equal rows may repeat.
    ``then`` and ``parts`` as in ``sum_counted``."""
    vsa, dim = codebook.vsa, codebook.dim
    ends = ["a", "b"] if pairs else ["idx"]
    if not codebook.fits:
        # A book of this size is joined, and never broadcast on the strength of an estimate.
        rows = counts.groupBy(key, *ends).agg(F.sum("cnt").alias("cnt"))
        for part in ends:
            book = named_rows(codebook, rows, part).spectral()
            rows = rows.join(book.table.select(F.col("idx").alias(part), F.col("hv").alias(f"_h{part}")).hint("merge"), part)
        rows = rows.withColumn("hv", V.bind("_ha", "_hb", vsa) if pairs else F.col("_hidx"))
        sums = bundle(rows, [key], weight="cnt").select(key, _finish_column(F.col("hv"), vsa).alias(out))
        return sums if then is None else sums.mapInArrow(*then)
    sent = counts.sparkSession.sparkContext.broadcast(codebook.matrix())
    rows = counts.select(key, F.col(ends[0]).alias("a"), *(["b"] if pairs else []), F.col("cnt").alias("n"))
    return sum_counted(rows, key, sent, out, pairs, lambda sums: B.vector_column(B.from_engine(sums, vsa, dim)), _vector_type(vsa), then, parts)


def node_terms(nodes: DataFrame, codebook: Codebook, then: tuple | None = None, parts: int = 0) -> DataFrame:
    """Sum of the node vectors of each graph. With ``then`` = (job on Arrow batches of (graph_id, node_terms), its schema) the rows of
    that job instead, which runs in the tasks that make the vectors."""
    rows = with_index(nodes, codebook.bins).select("graph_id", "idx", F.lit(1).alias("cnt"))
    return _sum_of_counts(rows, "graph_id", codebook, "node_terms", False, then, parts)


def edge_pairs(nodes: DataFrame, edges: DataFrame, bins: Sequence[int]) -> DataFrame:
    """(graph_id, a, b) of the tuples of every directed edge."""
    indexed = with_index(nodes, bins).select("graph_id", "node_id", "idx")
    source = indexed.select("graph_id", F.col("node_id").alias("src"), F.col("idx").alias("a"))
    target = indexed.select("graph_id", F.col("node_id").alias("dst"), F.col("idx").alias("b"))
    joined = edges.select("graph_id", "src", "dst").join(source, ["graph_id", "src"]).join(target, ["graph_id", "dst"])
    return joined.select("graph_id", "a", "b")


def edge_pair_counts(nodes: DataFrame, edges: DataFrame, bins: Sequence[int]) -> DataFrame:
    """How often each ordered pair of tuples is joined by a directed edge: (graph_id, a, b, cnt)."""
    return edge_pairs(nodes, edges, bins).groupBy("graph_id", "a", "b").agg(F.count("*").alias("cnt"))


def edge_terms(nodes: DataFrame, edges: DataFrame, codebook: Codebook, then: tuple | None = None, parts: int = 0) -> DataFrame:
    """Sum over directed edges of bind(source, target); graphs without edges get zeros. With ``then`` the rows of that job instead, as in
    ``node_terms``; it does not see graphs without edges."""
    rows = edge_pairs(nodes, edges, codebook.bins).withColumn("cnt", F.lit(1))
    if then is not None:
        return _sum_of_counts(rows, "graph_id", codebook, "edge_terms", True, then, parts)
    sums = _sum_of_counts(rows, "graph_id", codebook, "edge_terms", pairs=True)
    zeros = F.array_repeat(F.lit(0.0), codebook.dim)
    if codebook.vsa == "FHRR":
        zeros = F.struct(zeros.alias("re"), zeros.alias("im"))
    every = nodes.select("graph_id").distinct()
    return every.join(sums, "graph_id", "left").withColumn("edge_terms", F.coalesce("edge_terms", zeros))


def encode_edge_multiset(edges: DataFrame, codebook: Codebook, key: str = "graph_id", keys: DataFrame | None = None) -> DataFrame:
    """Σ cnt · bind(a, b) from rows (key, a, b, cnt). With ``keys``, those without an edge get a zero vector."""
    sums = _sum_of_counts(edges, key, codebook, "edge_vector", pairs=True)
    if keys is None:
        return sums
    zeros = F.array_repeat(F.lit(0.0), codebook.dim)
    if codebook.vsa == "FHRR":
        zeros = F.struct(zeros.alias("re"), zeros.alias("im"))
    return keys.select(key).join(sums, key, "left").withColumn("edge_vector", F.coalesce("edge_vector", zeros))


def nest_graphs(nodes: DataFrame, edges: DataFrame, node_cols: Sequence[str], edge_cols: Sequence[str]) -> DataFrame:
    """One row per graph with its node and edge lists. Only for graphs whose size was checked."""
    n = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", *node_cols)).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", *edge_cols)).alias("edges"))
    joined = n.join(e, "graph_id", "left")
    empty = F.array().cast(e.schema["edges"].dataType)
    return joined.withColumn("edges", F.coalesce("edges", empty))


class BatchEncoder:
    """Picklable job for ``mapInArrow`` over nested graphs: all layers of all members on one batch."""

    def __init__(self, sent, depths: Sequence[int], dims: Sequence[int], cfg: EncoderConfig, node_terms_book: int, terms: bool = True) -> None:
        self.sent, self.depths, self.dims = sent, list(depths), list(dims)
        self.vsa, self.normalize, self.normalize_graph = cfg.vsa, cfg.normalize, cfg.normalize_graph
        self.isolated, self.node_terms_book, self.terms = cfg.isolated, node_terms_book, terms

    def encode(self, flat: B.FlatGraphs) -> tuple[np.ndarray, ...]:
        """node_terms, edge_terms, graph_embedding of each graph of the batch, or the last alone."""
        embeddings, first_terms = [], []
        weight = flat.node.get("weight")
        for i, depth in enumerate(self.depths):
            known, matrix = self.sent.value[i]
            weights = B.measure(self.vsa, self.dims[i])
            start = matrix[rows_of(known, flat.node["idx"])]
            total, first = B.message_passing(flat, start, depth, self.normalize, weights, self.isolated)
            if weight is not None:
                total = total * weight[:, None]
            graph = B.segment_sum(total, flat.graph_of_node, flat.count)
            if self.normalize_graph:
                graph = B.unit_rows(graph, weights)
            embeddings.append(B.from_engine(graph, self.vsa, self.dims[i]))
            if i == 0 and self.terms:
                plain = start
                if self.node_terms_book:
                    known, matrix = self.sent.value[self.node_terms_book]
                    plain = matrix[rows_of(known, flat.node["full_idx"])]
                sums = [B.segment_sum(v, flat.graph_of_node, flat.count) for v in (plain, first)]
                first_terms = [B.from_engine(v, self.vsa, self.dims[i]) for v in sums]
        return (*first_terms, embeddings[0] if len(embeddings) == 1 else np.concatenate(embeddings, axis=1))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["graph_id", *(["node_terms", "edge_terms"] if self.terms else []), "graph_embedding"]
        for whole in batches:
            for piece in B.chunks(whole, max(self.dims), B.CELLS_IN_CACHE):
                columns = [B.vector_column(v) for v in self.encode(B.flatten_graphs(piece))]
                yield pa.RecordBatch.from_arrays([piece.column("graph_id"), *columns], names)


def _encoded_schema(vsa: str, terms: bool = True) -> str:
    kind = _vector_type(vsa)
    return f"graph_id long, node_terms {kind}, edge_terms {kind}, graph_embedding {kind}" if terms else f"graph_id long, graph_embedding {kind}"


def _encode_spread(nodes: DataFrame, edges: DataFrame, books: list[Codebook], depths: Sequence[int], cfg: EncoderConfig, full: Codebook | None) -> DataFrame:
    """The join path: no graph is ever in one task."""
    vsa = cfg.vsa
    weighted = "weight" in edges.columns
    degree = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.lit(True).alias("_has"))
    embedding = None
    for i, (book, depth) in enumerate(zip(books, depths, strict=True)):
        spectral = book.spectral()
        parseval = book.dim if vsa == "HRR" else 1
        state = nodes.join(spectral.joinable().select("idx", "hv"), "idx").select("graph_id", "node_id", "hv")
        layers = [state]
        first = None
        for layer in range(depth):
            sent = state.withColumnRenamed("node_id", "dst")
            messages = edges.join(sent, ["graph_id", "dst"])
            summed = bundle(messages, ["graph_id", "src"], weight="weight" if weighted else None)
            summed = summed.withColumnRenamed("src", "node_id").withColumnRenamed("hv", "_sum")
            ones = V.identity(vsa, book.dim)
            zeros = V.identity(vsa, book.dim) if cfg.isolated == "identity" else _zeros(vsa, book.dim)
            joined = state.join(summed, ["graph_id", "node_id"], "left")
            if cfg.isolated == "identity":
                joined = joined.join(degree, ["graph_id", "node_id"], "left")
                fill = F.when(F.col("_has").isNull(), ones).otherwise(zeros)
            else:
                fill = zeros
            bound = joined.select("graph_id", "node_id", V.bind("hv", F.coalesce("_sum", fill), vsa).alias("hv"))
            if layer == 0:
                first = bound
            if cfg.normalize:
                bound = bound.withColumn("hv", _unit(F.col("hv"), vsa, parseval))
            state = cut_lineage(bound)
            layers.append(state)
        total = layers[0]
        for extra in layers[1:]:
            total = total.unionByName(extra)
        readout = None
        if "weight" in nodes.columns:
            total = total.join(nodes.select("graph_id", "node_id", "weight"), ["graph_id", "node_id"])
            readout = "weight"
        graph = bundle(total, ["graph_id"], weight=readout, tree=True)
        if cfg.normalize_graph:
            graph = graph.withColumn("hv", _unit(F.col("hv"), vsa, parseval))
        graph = graph.select("graph_id", _finish_column(F.col("hv"), vsa).alias("graph_embedding"))
        if i == 0:
            plain = layers[0]
            if full is not None:
                plain = nodes.join(full.spectral().joinable().select(F.col("idx").alias("full_idx"), "hv"), "full_idx")
            terms = bundle(plain.select("graph_id", "hv"), ["graph_id"], tree=True)
            terms = terms.select("graph_id", _finish_column(F.col("hv"), vsa).alias("node_terms"))
            pairs = bundle(first, ["graph_id"], tree=True) if first is not None else terms.select("graph_id").withColumn("hv", _zeros(vsa, book.dim))
            pairs = pairs.select("graph_id", _finish_column(F.col("hv"), vsa).alias("edge_terms"))
            embedding = terms.join(pairs, "graph_id").join(graph, "graph_id")
        else:
            more = graph.withColumnRenamed("graph_embedding", "_more")
            embedding = embedding.join(more, "graph_id")
            if vsa == "FHRR":
                joined = F.struct(
                    F.concat("graph_embedding.re", "_more.re").alias("re"), F.concat("graph_embedding.im", "_more.im").alias("im")
                )
            else:
                joined = F.concat("graph_embedding", "_more")
            embedding = embedding.withColumn("graph_embedding", joined).drop("_more")
    return embedding.select("graph_id", "node_terms", "edge_terms", "graph_embedding")


def _zeros(vsa: str, dim: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.struct(zeros.alias("re"), zeros.alias("im")) if V.is_complex(vsa) else zeros


def _unit(hv: Column, vsa: str, parseval: int) -> Column:
    if not V.is_complex(vsa):
        return V.l2_normalize(hv)
    square = F.zip_with(hv["re"], hv["im"], lambda x, y: x * x + y * y)
    length = F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, v: acc + v) / F.lit(parseval)) + F.lit(V.EPSILON)
    return F.struct(
        F.flatten(F.transform(F.array(length), lambda n: F.transform(hv["re"], lambda v: v / n))).alias("re"),
        F.flatten(F.transform(F.array(length), lambda n: F.transform(hv["im"], lambda v: v / n))).alias("im"),
    )


def _encode(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, books: list[Codebook], depths: Sequence[int], full: Codebook | None = None, limit: int = GRAPH_LIMIT, sizes: DataFrame | None = None, terms: bool = True) -> DataFrame:
    node_cols = ["idx"] + [c for c in ("full_idx", "weight") if c in nodes.columns]
    edge_cols = [c for c in ("weight",) if c in edges.columns]
    nodes = nodes.select("graph_id", "node_id", *node_cols)
    edges = edges.select("graph_id", "src", "dst", *edge_cols)
    every_book = books + ([full] if full is not None else [])
    wanted = ["graph_id", *(["node_terms", "edge_terms"] if terms else []), "graph_embedding"]
    if not all(b.fits for b in every_book):
        return _encode_spread(nodes, edges, books, depths, cfg, full).select(*wanted)
    sent = nodes.sparkSession.sparkContext.broadcast([b.matrix() for b in every_book])
    task = BatchEncoder(sent, depths, [b.dim for b in books], cfg, len(books) if full is not None else 0, terms)

    def job(part_nodes: DataFrame, part_edges: DataFrame, together: bool) -> DataFrame:
        if not together:
            return _encode_spread(part_nodes, part_edges, books, depths, cfg, full).select(*wanted)
        return nest_graphs(part_nodes, part_edges, node_cols, edge_cols).mapInArrow(task, _encoded_schema(cfg.vsa, terms))

    return per_graph(nodes, edges, job, limit, sizes)


def codebook_for(spark: SparkSession, cfg: EncoderConfig) -> Codebook:
    """The codebook an encoder configuration stands for."""
    return make_codebook(spark, cfg.bins, cfg.dim, cfg.vsa, cfg.seed)


def encode(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, codebook: Codebook | None = None, limit: int = GRAPH_LIMIT, sizes: DataFrame | None = None, terms: bool = True) -> DataFrame:
    """(graph_id, node_terms, edge_terms, graph_embedding) for every graph, or without ``terms`` (graph_id, graph_embedding), where the
    other two are neither made nor sent. ``sizes`` may hold the graphs' ``graph_sizes``."""
    book = codebook or codebook_for(nodes.sparkSession, cfg)
    return _encode(with_index(nodes, cfg.bins), edges.drop("weight"), cfg, [book], [cfg.depth], limit=limit, sizes=sizes, terms=terms)


def encode_soft(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, codebook: Codebook | None = None, limit: int = GRAPH_LIMIT) -> DataFrame:
    """As ``encode`` with a weight in [0, 1] on every edge."""
    book = codebook or codebook_for(nodes.sparkSession, cfg)
    return _encode(with_index(nodes, cfg.bins), edges, cfg, [book], [cfg.depth], limit=limit)


def encode_weighted_readout(nodes: DataFrame, edges: DataFrame, weights: DataFrame, cfg: EncoderConfig, limit: int = GRAPH_LIMIT) -> DataFrame:
    """As ``encode`` with node weights (graph_id, node_id, weight) in the final sum."""
    weighted = with_index(nodes, cfg.bins).join(weights.select("graph_id", "node_id", "weight"), ["graph_id", "node_id"])
    return _encode(weighted, edges.drop("weight"), cfg, [codebook_for(nodes.sparkSession, cfg)], [cfg.depth], limit=limit)


def encode_split_rw(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, limit: int = GRAPH_LIMIT, books: Mapping[str, Codebook] | None = None) -> DataFrame:
    """Message passing on the base tuple; order-0 terms on the tuple with walk bins, from its own codebook (seed + 1000).

    With members, one encoder per (dim, depth), as in ``encode_ensemble``; the order-0 codebook has the first member's size.
    ``books`` are codebooks loaded with the configuration."""
    if cfg.walk is None:
        raise ValueError("encode_split_rw needs a walk configuration")
    spark, width = nodes.sparkSession, len(cfg.bins)
    base = with_index(nodes.withColumn("_base", F.slice("feat", 1, width)), cfg.bins, feat="_base")
    both = with_index(base.withColumnRenamed("idx", "_idx"), cfg.all_bins()).withColumnRenamed("idx", "full_idx")
    members = cfg.members or [(cfg.dim, cfg.depth)]
    full = books["full"] if books else make_codebook(spark, cfg.all_bins(), members[0][0], cfg.vsa, cfg.seed + 1000)
    if not full.fits:
        from braidvec.operators.codebook import prune_codebook

        full = prune_codebook(full, nodes.select("feat").distinct())
    own = _member_books(spark, cfg, books) if cfg.members else [books["nodes"] if books else codebook_for(spark, cfg)]
    return _encode(both.withColumnRenamed("_idx", "idx"), edges.drop("weight"), cfg, own, [depth for _, depth in members], full, limit)


def _member_books(spark, cfg: EncoderConfig, books: Mapping[str, Codebook] | None = None) -> list[Codebook]:
    if books:
        return [books[f"member_{i}"] for i in range(len(cfg.members))]
    return [make_codebook(spark, cfg.bins, dim, cfg.vsa, cfg.seed + i) for i, (dim, _) in enumerate(cfg.members)]


def encode_ensemble(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, limit: int = GRAPH_LIMIT, books: Mapping[str, Codebook] | None = None) -> DataFrame:
    """One encoder per (dim, depth) member, seed + i each; graph vectors are joined, terms come from the first. With a walk
    configuration ``nodes`` must carry the walk bins, and each member encodes as ``encode_split_rw`` does. ``books`` are the
    codebooks loaded with the configuration, in place of those made from the seed."""
    if not cfg.members:
        raise ValueError("encode_ensemble needs members")
    if cfg.walk is not None:
        return encode_split_rw(nodes, edges, cfg, limit, books)
    own = _member_books(nodes.sparkSession, cfg, books)
    return _encode(with_index(nodes, cfg.bins), edges.drop("weight"), cfg, own, [d for _, d in cfg.members], limit=limit)


def encode_dataset(nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, path: str | None = None) -> DataFrame:
    """Encode a whole split, with walk features when configured; writes parquet when a path is given."""
    if cfg.walk is not None:
        from braidvec.operators.walks import augment_rw

        out = encode_split_rw(augment_rw(nodes, edges, cfg.walk), edges, cfg)
    elif cfg.members:
        out = encode_ensemble(nodes, edges, cfg)
    else:
        out = encode(nodes, edges, cfg)
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    return nodes.sparkSession.read.parquet(path)


__all__ = [
    "GRAPH_LIMIT", "GROUP_LIMIT", "BatchEncoder", "bundle", "codebook_for", "edge_pair_counts", "edge_terms", "encode",
    "encode_dataset", "encode_edge_multiset", "encode_ensemble", "encode_soft", "encode_split_rw", "encode_weighted_readout",
    "nest_graphs", "node_terms",
]
