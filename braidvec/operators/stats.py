"""Statistics, sampling and model-ready tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidvec.functions import vsa as V
from braidvec.functions.batch import vector_column, vector_rows
from braidvec.functions.hashing import keyed_md5, unit_uniform
from braidvec.operators.contrastive import info_nce  # noqa: F401  (one of the scores of this module)
from braidvec.plans.skew import GROUP_LIMIT, if_small, large_keys, order_statistics, smallest_by_hash, split_large, with_global_rank
from braidvec.session import cut_lineage

MIN_STD = 1e-8


# ---------------------------------------------------------------- moments of vector columns


@dataclass(frozen=True)
class Moments:
    """Count, mean vector and centred sum of outer products."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial result per task: D rows (i, n, mean, row i of the centred scatter)."""
    n, mean, scatter = 0, None, None
    for batch in batches:
        x = vector_rows(batch.column(0))
        if not len(x):
            continue
        m = x.mean(axis=0)
        s = (x - m).T @ (x - m)
        if n == 0:
            n, mean, scatter = len(x), m, s
            continue
        total, delta = n + len(x), m - mean
        scatter += s + np.outer(delta, delta) * (n * len(x) / total)
        mean = mean + delta * (len(x) / total)
        n = total
    if n:
        d = len(mean)
        columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), vector_column(np.tile(mean, (d, 1))), vector_column(scatter)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "mean", "row"])


def _merge_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partial rows of the vector positions that this task owns, one batch at a time."""
    state: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        means, rows = vector_rows(batch.column("mean")), vector_rows(batch.column("row"))
        for i, n2, m2, r2 in zip(batch.column("i").to_pylist(), batch.column("n").to_pylist(), means, rows, strict=True):
            if i not in state:
                state[i] = (n2, m2, r2)
                continue
            n1, m1, r1 = state[i]
            delta = m2 - m1
            state[i] = (n1 + n2, m1 + delta * (n2 / (n1 + n2)), r1 + r2 + delta * delta[i] * (n1 * n2 / (n1 + n2)))
    if state:
        keys = sorted(state)
        columns = [
            pa.array(keys, pa.int32()), pa.array([state[k][0] for k in keys], pa.int64()),
            vector_column(np.array([state[k][1] for k in keys])), vector_column(np.array([state[k][2] for k in keys])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "mean", "row"])


def moments(df: DataFrame, vector: Column | str) -> Moments:
    """Mean and scatter matrix of a vector column. Partial sums per task, merged by vector position over the cluster;
    D rows of D numbers reach the driver, whatever the number of vectors."""
    schema = "i int, n long, mean array<double>, row array<double>"
    column = F.col(vector) if isinstance(vector, str) else vector
    partial = df.select(column.cast("array<double>").alias("v")).mapInArrow(_partial_moments, schema)
    merged = partial.repartition("i").mapInArrow(_merge_moments, schema).orderBy("i").collect()
    if not merged:
        raise ValueError("no vectors")
    return Moments(merged[0]["n"], np.array(merged[0]["mean"]), np.array([r["row"] for r in merged]))


def vector_stats(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per position (and key): mean and sample standard deviation, the latter at least 1e-8."""
    cells = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "_v"))
    out = cells.groupBy(*keys, "d").agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    return out.withColumn("std", F.greatest("std", F.lit(MIN_STD)))


def stats_arrays(stats: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and std vectors (D numbers each) from ``vector_stats``."""
    rows = stats.orderBy("d").collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def _constants(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def standardize(vector: Column | str, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x − mean) / std per position."""
    centred = F.zip_with(vector, _constants(mean), lambda x, m: x - m)
    return F.zip_with(centred, _constants(std), lambda x, s: x / s)


def destandardize(vector: Column | str, mean: Sequence[float], std: Sequence[float]) -> Column:
    """z · std + mean per position."""
    scaled = F.zip_with(vector, _constants(std), lambda z, s: z * s)
    return F.zip_with(scaled, _constants(mean), lambda z, m: z + m)


# ---------------------------------------------------------------- linear models from moments


@dataclass(frozen=True)
class Pca:
    """Component rows, data mean and variance ratio of every component."""

    components: np.ndarray
    mean: np.ndarray
    ratio: np.ndarray


def pca_fit(df: DataFrame, vector: str, n_components: int) -> Pca:
    """Centred principal components; each is signed so that its largest entry is positive."""
    m = moments(df, vector)
    if n_components > len(m.mean):
        raise ValueError("more components than dimensions")
    values, vectors = np.linalg.eigh(m.covariance())
    order = np.argsort(values)[::-1]
    values, rows = np.maximum(values[order], 0.0), vectors[:, order].T
    top = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    rows = rows * np.where(top < 0, -1.0, 1.0)[:, None]
    return Pca(rows[:n_components], m.mean, values / values.sum())


def _affine(df: DataFrame, vector: str, out: str, before: np.ndarray, matrix: np.ndarray, after: np.ndarray) -> DataFrame:
    """Append (v − before) @ matrix + after; the matrix has D × K numbers."""
    sent = df.sparkSession.sparkContext.broadcast((before, matrix, after))

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b, m, a = sent.value
        for rows in batches:
            yield pd.Series(list((np.stack(rows.to_numpy()) - b) @ m + a)) if len(rows) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(F.col(vector).cast("array<double>")))


def pca_project(df: DataFrame, vector: str, pca: Pca, out: str = "projected") -> DataFrame:
    return _affine(df, vector, out, pca.mean, pca.components.T, np.zeros(len(pca.components)))


def pca_inverse(df: DataFrame, vector: str, pca: Pca, out: str = "restored") -> DataFrame:
    return _affine(df, vector, out, np.zeros(len(pca.components)), pca.components, pca.mean)


def pca_roundtrip(df: DataFrame, vector: str, pca: Pca) -> DataFrame:
    """One row: mean, max and (lower middle) median cosine distance after projection and back."""
    back = pca_inverse(pca_project(df, vector, pca, "_p"), "_p", pca, "_back")
    distance = back.select((1 - V.cosine(F.col(vector).cast("array<double>"), "_back")).alias("_d")).persist()
    _, middle = order_statistics(distance, "_d", [0.5], "lower")
    return distance.agg(F.avg("_d").alias("mean"), F.max("_d").alias("max"), F.lit(middle[0] if middle else None).cast("double").alias("median"))


@dataclass(frozen=True)
class LinearMap:
    """y = x @ weights + bias, with the residual mean square error of the fit."""

    weights: np.ndarray
    bias: np.ndarray
    mse: float


def fit_linear_map(df: DataFrame, x: str, y: str) -> LinearMap:
    """Least squares with bias from one pass over the joint moments; a (Dx × Dy) solve on the driver."""
    width = len(df.select(x).first()[0])
    m = moments(df, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")))
    sxx, sxy, syy = m.scatter[:width, :width], m.scatter[:width, width:], m.scatter[width:, width:]
    weights = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    bias = m.mean[width:] - m.mean[:width] @ weights
    left = np.trace(syy - 2 * weights.T @ sxy + weights.T @ sxx @ weights)
    return LinearMap(weights, bias, float(left / (m.n * syy.shape[0])))


def apply_linear_map(df: DataFrame, x: str, model: LinearMap, out: str = "predicted") -> DataFrame:
    return _affine(df, x, out, np.zeros(len(model.weights)), model.weights, model.bias)


def property_regression(df: DataFrame, vector: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Linear regression of a scalar on a vector: (rows with ``prediction``, one row of mae, rmse, r2)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col(target).cast("double"))
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(data)
    out = model.transform(data).drop("_x")
    return out.drop("_y"), regression_metrics(out, "prediction", "_y")


def regression_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: mean absolute error, root mean square error, R²."""
    e = F.col(predicted) - F.col(actual)
    r2 = 1 - F.sum(e * e) / (F.var_pop(actual) * F.count("*"))
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"))


# ---------------------------------------------------------------- scores of vectors


def translation_loss(df: DataFrame, predicted: str, target: str, cosine_weight: float, mse_weight: float) -> DataFrame:
    """One row: mean cosine loss, mean square error per entry, and their weighted sum."""
    p, t = F.col(predicted).cast("array<double>"), F.col(target).cast("array<double>")
    row = df.select((1 - V.cosine(p, t)).alias("_c"), V.sq_dist(p, t).alias("_s"), F.size(p).alias("_n"))
    out = row.agg(F.avg("_c").alias("cosine_loss"), (F.sum("_s") / F.sum("_n")).alias("mse_loss"))
    return out.withColumn("loss", cosine_weight * F.col("cosine_loss") + mse_weight * F.col("mse_loss"))


def gaussian_nll(vector: Column | str, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Negative log-likelihood under independent normals: ½Σz² + ½D ln 2π + Σ ln σ."""
    z = standardize(vector, mean, std)
    constant = 0.5 * len(mean) * math.log(2 * math.pi) + sum(math.log(s) for s in std)
    return F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v * v) * 0.5 + F.lit(constant)


def bits_per_dim(nll: Column | str, dim: int) -> Column:
    nll = F.col(nll) if isinstance(nll, str) else nll
    return nll / F.lit(dim * math.log(2))


# ---------------------------------------------------------------- marginals and sizes


def _class_counts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, n, m) and (graph_id, bond, cnt)."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    sizes = sizes.join(m, "graph_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return sizes, edges.groupBy("graph_id", "bond").agg(F.count("*").alias("cnt"))


def _class_totals(nodes: DataFrame, edges: DataFrame, max_size: int | None = None) -> DataFrame:
    """(n, bond, cnt): class counts per graph size, with missing pairs counted as class 0."""
    sizes, counts = _class_counts(nodes, edges)
    if max_size is not None:
        sizes = sizes.filter(F.col("n") <= max_size)
    present = counts.join(sizes, "graph_id").select("n", "bond", "cnt")
    absent = sizes.select("n", F.lit(0).alias("bond"), (F.col("n") * (F.col("n") - 1) - F.col("m")).alias("cnt"))
    return present.unionByName(absent).groupBy("n", "bond").agg(F.sum("cnt").alias("cnt"))


def edge_marginals(nodes: DataFrame, edges: DataFrame, classes: int = 5) -> DataFrame:
    """Share of each class over all ordered node pairs: (bond, p)."""
    totals = _class_totals(nodes, edges).groupBy("bond").agg(F.sum("cnt").alias("cnt"))
    every = nodes.sparkSession.range(classes).select(F.col("id").cast("int").alias("bond"))
    filled = every.join(totals, "bond", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    # One row per class.
    return filled.select("bond", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).alias("p"))


def size_edge_marginals(nodes: DataFrame, edges: DataFrame, max_size: int, min_count: int = 50, classes: int = 5) -> DataFrame:
    """Class shares per graph size up to ``max_size``: (size, bond, p). Sizes with fewer than ``min_count`` graphs get
    the shares over all sizes; larger graphs are left out of both, as the table asks."""
    spark = nodes.sparkSession
    totals = _class_totals(nodes, edges, max_size)
    graphs = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("graphs"))
    grid = spark.range((max_size + 1) * classes).select(
        F.floor(F.col("id") / classes).cast("long").alias("n"), (F.col("id") % classes).cast("int").alias("bond")
    )
    filled = grid.join(totals, ["n", "bond"], "left").join(graphs, "n", "left").fillna(0, ["cnt", "graphs"])
    # (max_size + 1) × classes rows from here on.
    row_sum = F.sum("cnt").over(Window.partitionBy("n"))
    all_class, every = F.sum("cnt").over(Window.partitionBy("bond")), F.sum("cnt").over(Window.partitionBy())
    own, shared = F.col("cnt") / F.greatest(row_sum, F.lit(1)), all_class / F.greatest(every, F.lit(1))
    p = F.when(F.col("graphs") >= min_count, own).otherwise(shared)
    return filled.select(F.col("n").alias("size"), "bond", p.alias("p"))


def size_histogram(nodes: DataFrame) -> DataFrame:
    """Number of graphs of every size from 0 to the largest: (size, cnt)."""
    counts = nodes.groupBy("graph_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("cnt"))
    every = counts.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("size"))).alias("size"))
    return every.join(counts, "size", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def running_totals(counts: DataFrame, order: str, value: str) -> DataFrame:
    """Append ``lo`` and ``hi``, the sums of ``value`` before and up to each row in the order of a column without repeats: by a
    range-partitioned sort, windows inside the ranges, and one sum a range."""
    ordered = cut_lineage(counts.orderBy(order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    joined = ordered.withColumn("hi", F.sum(value).over(inside)).join(F.broadcast(first), "_part")
    return joined.withColumn("hi", F.col("hi") + F.col("_first")).withColumn("lo", F.col("hi") - F.col(value)).drop("_part", "_first")


# Least number of buckets that points are dealt into.
_BUCKETS = 1024


def sample_sizes(draws: DataFrame, histogram: DataFrame, seed: int, draw_id: str = "draw_id") -> DataFrame:
    """One size per draw, with replacement, in proportion to the histogram; null if that is empty.

    Every size stands for an interval of the running total. Points and intervals meet by bucket; with as many buckets as sizes, a
    point meets two intervals on average, whatever the distribution."""
    bounds = cut_lineage(running_totals(histogram.filter("cnt > 0").select("size", "cnt"), "size", "cnt"))
    n, total = bounds.agg(F.count("*"), F.max("hi")).first()
    if not n:
        return draws.select(draw_id, F.lit(None).cast("int").alias("size"))
    buckets = max(_BUCKETS, n)
    bucket = lambda x: F.least(F.floor(x * F.lit(float(buckets)) / F.lit(float(total))), F.lit(buckets - 1))
    spread = bounds.select("size", "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("_b"))
    points = draws.select(draw_id, (unit_uniform(keyed_md5(seed, F.col(draw_id))) * F.lit(float(total))).alias("_u"))
    met = points.withColumn("_b", bucket(F.col("_u"))).join(if_small(spread), "_b")
    return met.filter((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))).select(draw_id, F.col("size").cast("int").alias("size"))


# ---------------------------------------------------------------- sampling and splitting


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, the first in the order of md5(seed | id)."""
    marked = df.withColumn("_h", keyed_md5(seed, F.col(id_col)))
    return smallest_by_hash(marked, "_h", id_col, [n], "_band").filter("_band = 0").drop("_h", "_band")


def random_split(df: DataFrame, id_col: str, seed: int, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Append ``split``: int(train·n), int(valid·n) and the rest, in the order of md5(seed | id)."""
    n = df.count()
    n_train, n_valid = int(n * train), int(n * valid)
    marked = df.withColumn("_h", keyed_md5(seed, F.col(id_col)))
    banded = smallest_by_hash(marked, "_h", id_col, [n_train, n_train + n_valid], "_band")
    name = F.when(F.col("_band") == 0, "train").when(F.col("_band") == 1, "valid").otherwise("test")
    return banded.withColumn("split", name).drop("_h", "_band")


def size_strata(df: DataFrame, size_col: str, q: int = 4) -> DataFrame:
    """Append ``stratum`` from the distinct size quantiles (linear interpolation); an edge belongs to the lower side."""
    edges = sorted(set(order_statistics(df, size_col, [i / q for i in range(q + 1)])[1]))
    stratum = F.lit(0)
    for edge in edges[1:-1]:
        stratum = stratum + F.when(F.col(size_col) > edge, 1).otherwise(0)
    return df.withColumn("stratum", stratum)


def stratified_sample(df: DataFrame, id_col: str, size_col: str, n: int, seed: int, q: int = 4) -> DataFrame:
    """n rows spread over the size strata in proportion (largest remainders), by hash order inside each stratum."""
    marked = size_strata(df, size_col, q).withColumn("_h", keyed_md5(seed, F.col(id_col)))
    rows = marked.groupBy("stratum").count().orderBy("stratum").collect()
    total = sum(r["count"] for r in rows)
    if n >= total:
        return marked.drop("_h")
    exact = [(r["stratum"], n * r["count"] / total) for r in rows]
    take = {s: math.floor(x) for s, x in exact}
    for s, _ in sorted(exact, key=lambda e: (-(e[1] - math.floor(e[1])), e[0]))[: n - sum(take.values())]:
        take[s] += 1
    out = None
    for s, k in take.items():
        part = smallest_by_hash(marked.filter(F.col("stratum") == s), "_h", id_col, [k], "_band").filter("_band = 0")
        out = part if out is None else out.unionByName(part)
    return out.drop("_h", "_band")


def clean_and_dedup(df: DataFrame, cleaned: Column, id_col: str) -> DataFrame:
    """Rows with a non-null cleaned key, the first id per key; a minimum per key is combined map-side."""
    kept = df.withColumn("clean_key", cleaned).filter(F.col("clean_key").isNotNull())
    rest = [c for c in df.columns if c != id_col]
    first = kept.groupBy("clean_key").agg(F.min(F.struct(id_col)).alias("_id"), F.min_by(F.struct(*rest), id_col).alias("_r"))
    return first.select("clean_key", F.col(f"_id.{id_col}").alias(id_col), *[F.col(f"_r.{c}").alias(c) for c in rest])


def cleaning_report(df: DataFrame, cleaned: Column) -> DataFrame:
    """One row: raw, failed, duplicate and kept counts."""
    keys = df.select(cleaned.alias("_k"))
    groups = keys.groupBy("_k").agg(F.count("*").alias("_c"))
    failed = F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_c"))), F.lit(0))
    kept = F.count("_k")
    raw = F.coalesce(F.sum("_c"), F.lit(0))
    return groups.agg(raw.alias("raw"), failed.alias("failed"), kept.alias("kept"), (raw - failed - kept).alias("duplicates"))


# ---------------------------------------------------------------- series


def moving_average(df: DataFrame, key: str, order: Sequence[str], value: str, w: int, out: str = "smooth", limit: int = GROUP_LIMIT) -> DataFrame:
    """Trailing mean over up to w values of each series; a series shorter than w is returned as it is; NaN is dropped.

    A very long series is cut into blocks by position, and every block also receives the w − 1 values before it."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    large = large_keys(clean, [key], limit)
    small, big = split_large(clean, large, [key])
    cols = [F.col(c) for c in order]
    frame = Window.partitionBy(key).orderBy(*cols).rowsBetween(-(w - 1), 0)
    whole = Window.partitionBy(key)
    guarded = F.when(F.count("*").over(whole) < w, F.col(value)).otherwise(F.avg(value).over(frame))
    result = small.withColumn(out, guarded)
    if big is None:
        return result
    block = max(limit, 4 * w)
    ranked = with_global_rank(big, [F.col(key), *cols], "_g")
    first = ranked.groupBy(key).agg(F.min("_g").alias("_first"))
    placed = ranked.join(first, key).withColumn("_pos", F.col("_g") - F.col("_first"))
    own = F.floor(F.col("_pos") / block).cast("long")
    copies = F.array_distinct(F.array(own, F.floor((F.col("_pos") + (w - 1)) / block).cast("long")))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(copies))
    frame = Window.partitionBy(key, "_block").orderBy("_pos").rowsBetween(-(w - 1), 0)
    smooth = spread.withColumn(out, F.avg(value).over(frame)).filter("_block = _own")
    return result.unionByName(smooth.select(*result.columns))
