"""Plans that hold when one key carries a large share of all rows.

The common case (many keys of bounded size) keeps its one exchange by key. Keys above a limit are found with a
pre-aggregated count, and take a second, exact way in which no single task holds the whole key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidvec.session import BROADCAST_KEYS, cut_lineage

# Rows of one key that a single task may hold.
GROUP_LIMIT = 100_000
# Hash buckets in which keys are counted together before any key is counted by itself.
KEY_BUCKETS = 1 << 16


def large_keys(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. Few keys come marked for broadcast; many stay a table that is joined.

    Rows are counted by hash bucket first, which sends at most KEY_BUCKETS numbers a task. A large key makes its bucket large, so
    keys are counted one by one only in buckets above the limit: as a rule in none."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    over = df.select(bucket.alias("_bucket")).groupBy("_bucket").count().filter(F.col("count") > limit).select("_bucket")
    found = [r[0] for r in over.collect()]
    if not found:
        return None
    some = df.select(*keys)
    if len(found) < KEY_BUCKETS // 2:
        buckets = df.sparkSession.createDataFrame([(b,) for b in found], "_bucket int")
        some = some.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")
    return few_keys(some.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))


def few_keys(keys: DataFrame) -> DataFrame | None:
    """A table of keys that is expected to be small, read once: None if empty, marked for broadcast up to BROADCAST_KEYS rows."""
    found = keys.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= BROADCAST_KEYS:
        return F.broadcast(keys.sparkSession.createDataFrame(found, keys.schema))
    return cut_lineage(keys)


def if_small(df: DataFrame) -> DataFrame:
    """A caller's table, marked for broadcast if it has at most BROADCAST_KEYS rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def split_large(df: DataFrame, large: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of large keys."""
    if large is None:
        return df, None
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, size): nodes and edges of each graph. Written once, it serves all operators that run on the same graphs."""
    rows = nodes.select("graph_id").unionByName(edges.select("graph_id"))
    return rows.groupBy("graph_id").agg(F.count("*").alias("size"))


def per_graph(
    nodes: DataFrame,
    edges: DataFrame,
    job: Callable[[DataFrame, DataFrame, bool], DataFrame],
    limit: int = GROUP_LIMIT,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Run ``job(nodes, edges, together)`` on the ordinary graphs, brought together once by graph_id, and on the
    large graphs, left spread over the cluster (``together`` is False there). ``sizes`` saves counting the rows here."""
    safe_unions(nodes.sparkSession)
    if sizes is None:
        large = large_keys(nodes.select("graph_id").unionByName(edges.select("graph_id")), ["graph_id"], limit)
    else:
        large = few_keys(sizes.filter(F.col("size") > limit).select("graph_id"))
    small_nodes, large_nodes = split_large(nodes, large, ["graph_id"])
    small_edges, large_edges = split_large(edges, large, ["graph_id"])
    out = job(together(small_nodes), together(small_edges), True)
    if large is None:
        return out
    return out.unionByName(job(apart(large_nodes, "node_id"), apart(large_edges, "src"), False))


def apart(df: DataFrame, column: str) -> DataFrame:
    """Hash-partition by (graph_id, column), so that an earlier partitioning by graph_id cannot hold a large graph in one task."""
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, "graph_id", column)


def safe_unions(spark) -> None:
    """A union of tables that are partitioned alike must not claim their partitioning: with nested unions the claim is wrong in
    the number of partitions, and the plan fails."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def together(df: DataFrame) -> DataFrame:
    """Hash-partition by graph_id; later joins and aggregates on (graph_id, ...) reuse this.

    The number of partitions is given, so that adaptive execution does not merge them by the size of these narrow rows:
    the vectors and paths made from them later are many times larger."""
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, "graph_id")


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Append the 0-based position in the total order, by a range-partitioned sort and per-partition offsets.

    No task sees more than one range. Only one count per partition reaches the driver.
    """
    step = 1 << 33  # monotonically_increasing_id puts the partition number above this bit
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    part = F.floor(F.col("_mono") / F.lit(step)).cast("int")
    counts = ordered.groupBy(part.alias("_part")).count().collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["count"]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_part int, _offset long") if offsets else spark.createDataFrame([], "_part int, _offset long")
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mono").bitwiseAND(F.lit(step - 1)))
        .drop("_part", "_offset", "_mono")
    )


def with_group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    limit: int = GROUP_LIMIT,
    size: str | None = None,
    back: tuple[str, int, str] | None = None,
) -> DataFrame:
    """Append the 0-based position inside each key. Large keys are ranked by a range-partitioned sort.

    From the same exchange and sort come, where asked for, the number of rows of the key as ``size``, and with
    ``back`` = (column, steps, name) the column's value so many positions before, null at the first ones."""
    large = large_keys(df, keys, limit)
    small, big = split_large(df, large, keys)
    group = Window.partitionBy(*keys)
    window = group.orderBy(*order)
    added = {name: (F.row_number().over(window) - 1).cast("long")}
    if back:
        added[back[2]] = F.lag(back[0], back[1]).over(window)
    out = small.withColumns(added)
    if size:
        out = out.withColumn(size, F.count(F.lit(1)).over(group))
    if big is None:
        return out
    ranked = with_global_rank(big, [*[F.col(k) for k in keys], *order], "_global")
    first = ranked.groupBy(*keys).agg(F.min("_global").alias("_first"), *([F.count("*").alias(size)] if size else []))
    ranked = ranked.join(first, list(keys)).withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_first")
    if back:
        before = ranked.select(*keys, (F.col(name) + back[1]).alias(name), F.col(back[0]).alias(back[2]))
        ranked = ranked.join(before, [*keys, name], "left")
    return out.unionByName(ranked)


def order_statistics(df: DataFrame, value: str, shares: Sequence[float], method: str = "linear", weight: str | None = None) -> tuple[int, list[float]]:
    """(n, exact quantiles of the non-null values). ``lower`` takes the lower of two middle values, ``linear`` goes between.
    With ``weight`` a row stands for that many equal values.

    Equal values are merged into counts first, so a frequent value is one row. The distinct values are sorted by range, and
    only the ranges that hold a wanted position are summed up inside; no task sees the whole column."""
    times = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(times.alias("_c"))
    ordered = cut_lineage(counts.orderBy("_v").withColumn("_part", F.spark_partition_id()))
    parts = sorted(ordered.groupBy("_part").agg(F.sum("_c").alias("_c")).collect(), key=lambda r: r["_part"])
    begin, n = {}, 0
    for row in parts:
        begin[row["_part"]] = n
        n += row["_c"]
    if n == 0:
        return 0, []
    wanted: list[tuple[int, int, float]] = []
    for share in shares:
        at = (n - 1) * share
        low = math.floor(at + 1e-12)
        wanted.append((low, low, 0.0) if method == "lower" else (low, min(low + 1, n - 1), at - low))
    ranks = sorted({r for low, high, _ in wanted for r in (low, high)})
    holding = {max(p for p, first in begin.items() if first <= r) for r in ranks}
    running = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ordered.filter(F.col("_part").isin(sorted(holding))).withColumn("_end", F.sum("_c").over(running))
    first = F.lit(0)
    for p in sorted(holding):
        first = F.when(F.col("_part") == p, begin[p]).otherwise(first)
    placed = inside.withColumn("_end", F.col("_end") + first)
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("_end") > r) & (F.col("_end") - F.col("_c") <= r))
    found = placed.filter(hit).collect()
    at_rank = {r: float(row["_v"]) for r in ranks for row in found if row["_end"] - row["_c"] <= r < row["_end"]}
    return n, [at_rank[low] + (at_rank[high] - at_rank[low]) * share for low, high, share in wanted]


def smallest_by_hash(df: DataFrame, hash_col: str, tie: str, wanted: Sequence[int], name: str = "band") -> DataFrame:
    """Split rows, in the order (hash, tie), at exact positions: ``band`` is the number of cut points passed.

    ``hash_col`` is a uniform hex string. Rows are counted by its first four digits (65 536 buckets at most); only the
    buckets that hold a cut point are ranked, so nothing is sorted as a whole.
    """
    bucket = F.substring(hash_col, 1, 4)
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").count()
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_end", F.sum("count").over(running)).withColumn("_begin", F.col("_end") - F.col("count"))
    holds_cut = F.lit(False)
    passed_before = F.lit(0)
    for cut in wanted:
        holds_cut = holds_cut | ((F.col("_begin") < cut) & (F.col("_end") > cut))
        passed_before = passed_before + F.when(F.col("_begin") >= cut, 1).otherwise(0)
    ends = ends.select("_bucket", "_begin", holds_cut.alias("_cut"), passed_before.alias("_passed"))
    joined = marked.join(F.broadcast(ends), "_bucket")
    whole = joined.filter(~F.col("_cut")).withColumn(name, F.col("_passed"))
    within = Window.partitionBy("_bucket").orderBy(hash_col, tie)
    split = joined.filter("_cut").withColumn("_pos", F.col("_begin") + F.row_number().over(within) - 1)
    passed = F.lit(0)
    for cut in wanted:
        passed = passed + F.when(F.col("_pos") >= cut, 1).otherwise(0)
    split = split.withColumn(name, passed).drop("_pos")
    helpers = ["_bucket", "_begin", "_cut", "_passed"]
    return whole.drop(*helpers).unionByName(split.drop(*helpers))
