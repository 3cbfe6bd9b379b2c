"""The symmetric contrastive score of batches of any size.

A small batch is scored by one task. A large one is cut into groups of rows, and every pair of groups is a cell of a grid: a task
multiplies the two groups of a cell and sends, for each row and column of it, a mergeable pair (peak, sum of exp(logit − peak)). No
task sees more than two groups, and no logit leaves the task that made it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidvec.functions.batch import vector_rows
from braidvec.plans.skew import if_small
from braidvec.session import cut_lineage

# Rows of one group of the grid; also the largest batch that one task scores alone.
GROUP_ROWS = 1 << 15
# Numbers of one side of a cell, however few rows a group is asked to have (8 bytes each).
GROUP_CELLS = 1 << 21
# Cells of the grid for each task; a finer grid only sends every row more often.
CELLS_A_TASK = 8
# Logits that a task holds at a time (8 bytes each).
LOGITS_AT_ONCE = 1 << 22
# The same where they are bounded, rows and columns: made, raised and added up inside the cache.
TILE_ROWS, TILE_COLUMNS = 128, 1024
# Largest logit up to which all of them share one peak without their powers vanishing.
SHARED_PEAK = 300.0


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _log_sums(left: np.ndarray, right: np.ndarray, temperature: float, block: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row peaks, row sums, column peaks, column sums) of the logits, made some rows at a time.

    Cosines are at most 1, so a usual temperature bounds all logits. They then share that bound as their peak, and rows and columns
    are summed from the same powers."""
    if 1 / abs(temperature) <= SHARED_PEAK:
        return _bounded_sums(left, right, temperature, block)
    step = block or max(1, LOGITS_AT_ONCE // max(len(right), 1))
    row_peak, row_sum = np.empty(len(left)), np.empty(len(left))
    peak, total = np.full(len(right), -np.inf), np.zeros(len(right))
    for low in range(0, len(left), step):
        logits = left[low : low + step] @ right.T / temperature
        rows = slice(low, low + len(logits))
        row_peak[rows] = logits.max(axis=1)
        row_sum[rows] = np.exp(logits - row_peak[rows, None]).sum(axis=1)
        higher = np.maximum(peak, logits.max(axis=0))
        total = total * np.exp(peak - higher) + np.exp(logits - higher[None, :]).sum(axis=0)
        peak = higher
    return row_peak, row_sum, peak, total


def _bounded_sums(left: np.ndarray, right: np.ndarray, temperature: float, block: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    peak = 1 / abs(temperature)
    step = min(block or TILE_ROWS, TILE_ROWS)
    rows = np.column_stack([left, np.ones(len(left))])
    columns = np.ascontiguousarray(np.column_stack([right / temperature, np.full(len(right), -peak)]).T)
    row_sum, total = np.zeros(len(left)), np.zeros(len(right))
    ones = np.ones(step)
    for at in range(0, len(right), TILE_COLUMNS):
        some = np.ascontiguousarray(columns[:, at : at + TILE_COLUMNS])
        unit, added = np.ones(some.shape[1]), np.zeros(some.shape[1])
        for low in range(0, len(left), step):
            powers = rows[low : low + step] @ some
            np.exp(powers, out=powers)
            row_sum[low : low + step] += powers @ unit
            added += ones[: len(powers)] @ powers
        total[at : at + TILE_COLUMNS] = added
    return np.full(len(left), peak), row_sum, np.full(len(right), peak), total


def _grid_side(rows: Column, group_rows: int, width: int, tasks: int) -> Column:
    """Groups that a batch is cut into: of about ``group_rows`` rows, but no more than give each task its cells, unless a group
    would pass GROUP_CELLS numbers."""
    asked, useful = F.ceil(rows / group_rows), math.ceil(math.sqrt(CELLS_A_TASK * tasks))
    needed = F.ceil(rows / max(GROUP_CELLS // max(width, 1), 1))
    return F.least(asked, F.greatest(needed, F.lit(useful).cast("long"))).cast("int")


def info_nce(df: DataFrame, batch: str, a: str, b: str, temperature: float, block: int | None = None, limit: int = GROUP_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Symmetric contrastive score per batch: (batch, n, loss), the mean over both directions of −log softmax of the own pair.

    Rows of one batch are each other's negatives; a null batch is a batch of its own. Batches of up to ``limit`` rows are scored
    by one task, larger ones on a grid of groups of about ``group_rows`` rows, of which a task holds two. What a row is sent grows with
    the number of groups, so there are only as many as keep the tasks busy; groups then have more rows, up to GROUP_CELLS numbers.
    ``block`` sets the rows whose logits are made at a time. Vectors must not be null; a zero vector has logit 0 with every other."""
    kind = df.schema[batch].dataType.simpleString()
    rows = df.select(F.col(batch).alias("_batch"), F.col(a).cast("array<double>").alias("_a"), F.col(b).cast("array<double>").alias("_b"))
    large = cut_lineage(rows.groupBy("_batch").count().filter(F.col("count") > limit))
    out = _scored_alone(rows, kind, temperature, block) if large.isEmpty() else None
    if out is None:
        spark = df.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        width = rows.select(F.size("_a")).first()[0]
        known = if_small(large.select(F.col("_batch").alias("_large"), _grid_side(F.col("count"), group_rows, width, tasks).alias("_g")))
        same = F.col("_batch").eqNullSafe(F.col("_large"))
        small = rows.join(known, same, "left_anti")
        out = _scored_alone(small, kind, temperature, block).unionByName(_scored_on_a_grid(rows.join(known, same).drop("_large"), kind, temperature, block))
    return out.withColumnRenamed("_batch", batch)


def _scored_alone(rows: DataFrame, kind: str, temperature: float, block: int | None) -> DataFrame:
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _unit(np.stack(pdf["_a"].to_numpy())), _unit(np.stack(pdf["_b"].to_numpy()))
        own = float((left * right).sum()) / temperature
        row_peak, row_sum, peak, total = _log_sums(left, right, temperature, block)
        both = float((row_peak + np.log(row_sum)).sum() + (peak + np.log(total)).sum())
        return pd.DataFrame({"_batch": [pdf["_batch"].iloc[0]], "n": [len(pdf)], "loss": [(both / 2 - own) / len(pdf)]})

    return rows.groupBy("_batch").applyInPandas(score, f"_batch {kind}, n long, loss double")


def _scored_on_a_grid(rows: DataFrame, kind: str, temperature: float, block: int | None) -> DataFrame:
    """Rows carry ``_g``, the number of groups of their batch. Every row goes to its group's g cells on either side."""
    numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = numbered.withColumn("_own", F.pmod(F.xxhash64("_row"), F.col("_g")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    left = placed.select("_batch", F.col("_own").alias("_p"), every.alias("_q"), "_row", F.col("_a").alias("_v"))
    right = placed.select("_batch", every.alias("_p"), F.col("_own").alias("_q"), "_row", F.col("_b").alias("_v"))

    def cell(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        names = ["_batch", "side", "_row", "peak", "total", "own"]
        first, second = one.column("_row").to_numpy(), other.column("_row").to_numpy()
        sides = []
        if len(first) and len(second):
            x, y = (_unit(vector_rows(t.column("_v").combine_chunks())) for t in (one, other))
            row_peak, row_sum, peak, total = _log_sums(x, y, temperature, block)
            own = np.full(len(first), np.nan)
            if key[1].as_py() == key[2].as_py():  # both sides hold the same rows here
                own[np.argsort(first)] = (x[np.argsort(first)] * y[np.argsort(second)]).sum(axis=1) / temperature
            sides = [(0, first, row_peak, row_sum, own), (1, second, peak, total, np.full(len(second), np.nan))]
        parts = [
            pa.table([pa.array([key[0].as_py()] * len(ids), key[0].type), pa.array([side] * len(ids), pa.int32()), ids, high, total, pa.array(own, from_pandas=True)], names)
            for side, ids, high, total, own in sides
        ]
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (key[0].type, pa.int32(), pa.int64(), *[pa.float64()] * 3)], names)

    keys = ["_batch", "_p", "_q"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"_batch {kind}, side int, _row long, peak double, total double, own double")
    line = ["_batch", "side", "_row"]
    raised = cells.withColumn("_m", F.max("peak").over(Window.partitionBy(*line)))
    # The window and this sum share one exchange by line.
    lines = raised.groupBy(*line, "_m").agg(F.sum(F.col("total") * F.exp(F.col("peak") - F.col("_m"))).alias("_s"), F.sum("own").alias("own"))
    both = F.sum(F.col("_m") + F.log("_s")) / 2 - F.sum("own")
    n = F.count_if(F.col("side") == 0)
    return lines.groupBy("_batch").agg(n.alias("n"), (both / n).alias("loss"))
