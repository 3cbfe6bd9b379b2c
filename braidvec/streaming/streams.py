"""Endless supply, checking and encoding of graphs as Structured Streaming jobs.

Graphs travel as nested rows, one per graph (``schema.NESTED_GRAPH``). Draws are functions of a row number, so a replayed
micro-batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from braidvec.functions import batch as B
from braidvec.functions.features import bin_walk, feature_index
from braidvec.functions.hashing import hex_number, keyed_md5, unit_uniform
from braidvec.operators.codebook import Codebook, make_codebook
from braidvec.operators.encode import GRAPH_LIMIT, BatchEncoder, _vector_type
from braidvec.plans.skew import large_keys, with_global_rank
from braidvec.schema import EncoderConfig
from braidvec.session import BROADCAST_KEYS


def draws(spark: SparkSession, rows_per_batch: int) -> DataFrame:
    """Endless numbered rows, a fixed number per micro-batch: one micro-batch is one training batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()


def index_pool(pool: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Pool with positions 0..n−1 in a fixed order, and n."""
    placed = with_global_rank(pool, [F.col(c) for c in order], "pos")
    n = placed.count()
    if n == 0:
        raise ValueError("the pool is empty")
    return placed, n


def _side(pool: DataFrame, n: int) -> DataFrame:
    return F.broadcast(pool) if n <= BROADCAST_KEYS else pool


def stream_pool_samples(stream: DataFrame, pool: DataFrame, n: int, seed: int, value: str = "value") -> DataFrame:
    """One uniform draw with replacement from an indexed pool per stream row."""
    pos = F.pmod(hex_number(keyed_md5(seed, F.col(value))), F.lit(n))
    return stream.withColumn("pos", pos).join(_side(pool, n), "pos")


def mix_streams(stream: DataFrame, pools: Mapping[str, tuple[DataFrame, int]], weights: Mapping[str, float], seed: int, value: str = "value") -> DataFrame:
    """For each stream row choose a source by normalised weight, then a uniform draw from its indexed pool.

    A single stream is split by hash, so the sources advance together and no source can starve another."""
    if not pools:
        raise ValueError("at least one source is required")
    total = sum(weights[name] for name in pools)
    if total <= 0:
        raise ValueError("the total weight must be positive")
    digest = keyed_md5(seed, F.col(value))
    u, source, size, done = unit_uniform(digest), F.lit(None).cast("string"), F.lit(1), 0.0
    names = list(pools)
    for name in reversed(names):
        share = weights[name] / total
        bound = 1.0 - done
        done += share
        source = F.lit(name) if name == names[-1] else F.when(u < bound, name).otherwise(source)
    for name, (_, n) in pools.items():
        size = F.when(F.col("source") == name, n).otherwise(size)
    marked = stream.withColumn("source", source).withColumn("pos", F.pmod(hex_number(digest, 14), size))
    every = None
    for name, (pool, _) in pools.items():
        part = pool.withColumn("source", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return marked.join(_side(every, sum(n for _, n in pools.values())), ["source", "pos"])


def take_steps(df: DataFrame, batch_size: int, steps: int, value: str = "value") -> DataFrame:
    """Rows of a fixed-length epoch with their batch number."""
    return df.filter(F.col(value) < batch_size * steps).withColumn("batch_no", F.floor(F.col(value) / batch_size).cast("long"))


def run_steps(stream: DataFrame, steps: int, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``step(batch, number)`` on exactly ``steps`` micro-batches of an endless stream, then stop."""

    def once(batch: DataFrame, number: int) -> None:
        if number < steps:
            step(batch, number)

    query = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).start()
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < steps - 1):
        query.awaitTermination(0.2)
    query.stop()


def run_epoch(pool: DataFrame, order: Sequence[str], batch_size: int, folder: str, step: Callable[[DataFrame, int], None]) -> int:
    """Every row of a pool exactly once, in a fixed order: ``step(rows, number)`` on ⌈n / batch_size⌉ micro-batches of an endless
    stream of numbers; returns their count. Rows carry their position ``pos``.

    The pool is written once, ordered by position, so a micro-batch reads its own range of positions only. A replayed micro-batch
    gets the same rows, so a step that overwrites what it wrote under its number is exact. An empty pool raises."""
    placed, n = index_pool(pool, order)
    path = f"{folder}/pool"
    placed.write.mode("overwrite").parquet(path)
    steps = -(-n // batch_size)

    def once(batch: DataFrame, number: int) -> None:
        low = number * batch_size
        rows = batch.sparkSession.read.parquet(path).filter(F.col("pos").between(low, low + batch_size - 1))
        step(batch.select(F.col("value").alias("pos")).join(rows, "pos"), number)

    run_steps(draws(pool.sparkSession, batch_size), steps, once, f"{folder}/steps")
    return steps


# ---------------------------------------------------------------- nested graphs


def nested_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Batch form of the stream rows: one nested row per graph. A graph too large to be one row is refused; the batch
    encoder spreads such graphs over the cluster."""
    if large_keys(nodes.select("graph_id").unionByName(edges.select("graph_id")), ["graph_id"], GRAPH_LIMIT) is not None:
        raise ValueError(f"a graph has more than {GRAPH_LIMIT} nodes and edges; use encode for it")
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "feat"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    empty = F.array().cast(e.schema["edges"].dataType)
    return n.join(e, "graph_id", "left").withColumn("edges", F.coalesce("edges", empty))


def _count_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = B.flatten_graphs(batch)
        roots = B.component_labels(flat) == np.arange(len(flat.graph_of_node))
        counts = np.bincount(flat.graph_of_node, weights=roots, minlength=flat.count).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*batch.schema.names, "n_components"])


def stream_validate(graphs: DataFrame, max_nodes: int, allowed: Sequence[int] | None = None) -> DataFrame:
    """Append ``reason``: oversized, disconnected, unsupported, no_edges or valid, tested in that order."""
    schema = T.StructType([*graphs.schema.fields, T.StructField("n_components", T.LongType())])
    counted = graphs.mapInArrow(_count_components, schema)
    odd = F.lit(False) if allowed is None else F.exists("nodes", lambda x: ~x["feat"][0].isin(list(allowed)))
    reason = (
        F.when(F.size("nodes") > max_nodes, "oversized").when(F.col("n_components") > 1, "disconnected")
        .when(odd, "unsupported").when(F.size("edges") == 0, "no_edges").otherwise("valid")
    )
    return counted.withColumn("reason", reason).drop("n_components")


def _with_walk(graphs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Nested graphs with the return probabilities of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = B.flatten_graphs(batch)
            rows = B.vector_column(B.return_probabilities(flat, list(ks)))
            sizes = np.bincount(flat.graph_of_node, minlength=flat.count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, rows)], [*batch.schema.names, "rw"])

    rw = T.StructField("rw", T.ArrayType(T.ArrayType(T.DoubleType())))
    return graphs.mapInArrow(run, T.StructType([*graphs.schema.fields, rw]))


def stream_encode(graphs: DataFrame, cfg: EncoderConfig, codebook: Codebook | None = None) -> DataFrame:
    """(graph_id, vector): [order-0 | order-N] in single precision, the same numbers as the batch encoder."""
    spark = graphs.sparkSession
    book = codebook or make_codebook(spark, cfg.bins, cfg.dim, cfg.vsa, cfg.seed)
    books, width = [book], len(cfg.bins)
    if cfg.walk is None:
        indexed = F.transform("nodes", lambda x: F.struct(x["node_id"].alias("node_id"), feature_index(x["feat"], cfg.bins).alias("idx")))
    else:
        walk = cfg.walk
        graphs = _with_walk(graphs, walk.ks)
        books.append(make_codebook(spark, cfg.all_bins(), cfg.dim, cfg.vsa, cfg.seed + 1000))

        def with_bins(x, r):
            bins = F.array(*[bin_walk(r[i], k, walk) for i, k in enumerate(walk.ks)])
            base = F.slice(x["feat"], 1, width)
            return F.struct(x["node_id"].alias("node_id"), feature_index(base, cfg.bins).alias("idx"), feature_index(F.concat(base, bins), cfg.all_bins()).alias("full_idx"))

        indexed = F.zip_with("nodes", "rw", with_bins)
    rows = graphs.select("graph_id", indexed.alias("nodes"), "edges")
    sent = spark.sparkContext.broadcast([b.matrix() for b in books])
    task = BatchEncoder(sent, [cfg.depth], [cfg.dim], cfg, 1 if cfg.walk is not None else 0)
    kind = _vector_type(cfg.vsa)
    encoded = rows.mapInArrow(task, f"graph_id long, node_terms {kind}, edge_terms {kind}, graph_embedding {kind}")
    if cfg.vsa == "FHRR":
        parts = [F.concat(f"node_terms.{p}", f"graph_embedding.{p}").cast("array<float>").alias(p) for p in ("re", "im")]
        return encoded.select("graph_id", F.struct(*parts).alias("vector"))
    return encoded.select("graph_id", F.concat("node_terms", "graph_embedding").cast("array<float>").alias("vector"))


# ---------------------------------------------------------------- running results


def stream_rejections(checked: DataFrame) -> DataFrame:
    """Running count per reason; write it in update or complete mode."""
    return checked.groupBy("reason").agg(F.count("*").alias("cnt"))


def stream_novel(stream: DataFrame, reference: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Keys that are neither in the reference nor seen before. With an event-time column the memory of seen keys is
    bounded by the delay; without one all seen keys are kept in the state store."""
    fresh = stream.join(reference.select(key).distinct(), key, "left_anti")
    if time is None:
        return fresh.dropDuplicates([key])
    return fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def write_key_store(keys: DataFrame, key: str, store: str, buckets: int) -> None:
    """Known keys as a table in hash buckets, the start of what ``run_novel`` reads and adds to. Null keys are left out."""
    known = keys.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("bucket", _bucket(key, buckets))
    known.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch=-1")


def run_novel(stream: DataFrame, key: str, store: str, buckets: int, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the first row of every key that is neither in the store nor came before, over all time and with no streaming state.

    A micro-batch reads the buckets of its own keys only; its new keys go to ``sink/batch=<number>`` and into the store under the
    same number. Both are overwritten, and the store is read below the number, so a replayed micro-batch gives the same keys.
    Null keys are dropped; which of several rows of a key in one micro-batch is kept is not fixed."""
    schema = T.StructType([stream.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", _bucket(key, buckets)).persist()
        # At most one number a bucket.
        touched = [r["bucket"] for r in marked.select("bucket").distinct().collect()]
        known = spark.read.schema(schema).parquet(store).filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
        marked.join(known.select(key, "bucket"), [key, "bucket"], "left_anti").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        marked.unpersist()
        fresh = spark.read.schema(marked.schema).parquet(f"{sink}/batch={number}").select(key, "bucket")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fold_key_store(spark: SparkSession, store: str, target: str, key: str) -> None:
    """The keys of a store in as few files as buckets, in a new folder: for a stopped stream whose many small additions slow its
    reads. All additions count as known from the start there."""
    keys = spark.read.parquet(store).select(key, "bucket")
    keys.repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/batch=-1")


def buffer_stats(log: DataFrame, source: str, size: str, order: Sequence[str], capacity: int, sources: DataFrame | None = None) -> DataFrame:
    """Per source: min, max, mean, utilisation in percent and the last ten sizes; zeros for a source without entries.

    The last ten come from a row-number limit, which every task applies before the shuffle."""
    stats = log.groupBy(source).agg(F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean"))
    last = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    tail = log.withColumn("_r", F.row_number().over(last)).filter("_r <= 10")
    tail = tail.groupBy(source).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_r", F.col(size).alias("_s"))))).alias("_t"))
    out = stats.join(tail.select(source, F.col("_t._s").alias("samples")), source)
    if sources is not None:
        out = sources.select(source).distinct().join(out, source, "left").fillna(0, ["min", "max", "mean"])
        out = out.withColumn("samples", F.coalesce("samples", F.array().cast(out.schema["samples"].dataType)))
    used = 100 * F.col("mean") / capacity if capacity > 0 else F.lit(0.0)
    return out.withColumn("utilization_pct", used)


def write_once(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there now into parquet files under ``folder`` and stop."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
