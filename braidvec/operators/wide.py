"""Principal components of vectors too wide for a D × D matrix.

A block Krylov search from a Gaussian start: each round is one pass that multiplies the covariance with a narrow block (D × width)
and adds the tasks' products by slices of D in a tree. The driver keeps a few such blocks, never D × D numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidvec.functions.batch import vector_column, vector_rows
from braidvec.operators.bundling import bundle
from braidvec.operators.stats import Pca
from braidvec.session import BROADCAST_CELLS

# Blocks kept before the search restarts from its best vectors.
BLOCKS_KEPT = 8
# Rows of a product that travel as one array.
SLICE_ROWS = 1024
# Cells of centred vectors that a task holds at a time.
CELLS_AT_ONCE = 1 << 22


def _sum_row(df: DataFrame, column: str) -> np.ndarray:
    row = bundle(df.withColumn("_one", F.lit(0)), ["_one"], column, tree=True).first()
    return np.array(row[column])


def _covariance_times(rows: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(covariance @ block, total variance), by one pass over the vectors."""
    dim, width = block.shape
    sent = rows.sparkSession.sparkContext.broadcast((mean, block))
    slices = -(-dim // SLICE_ROWS)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = sent.value
        # One more entry after each slice; that of the first slice carries the squared lengths.
        total, squares = np.zeros((slices * SLICE_ROWS, width)), 0.0
        step = max(1, CELLS_AT_ONCE // dim)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                x = vector_rows(batch.column(0).slice(low, step)) - centre
                total[:dim] += x.T @ (x @ q)
                squares += float((x * x).sum())
        parts = total.reshape(slices, SLICE_ROWS * width)
        parts = np.concatenate([parts, np.zeros((slices, 1))], axis=1)
        parts[0, -1] = squares
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), vector_column(parts)], ["at", "v"])

    partial = rows.mapInArrow(products, "at int, v array<double>")
    found = sorted(bundle(partial, ["at"], "v", tree=True).collect(), key=lambda r: r["at"])
    sent.unpersist()
    parts = np.array([r["v"] for r in found])
    scale = max(n - 1, 1)
    return parts[:, :-1].reshape(slices * SLICE_ROWS, width)[:dim] / scale, float(parts[0, -1]) / scale


def _orthonormal(block: np.ndarray, basis: np.ndarray | None, least: float) -> np.ndarray:
    """Orthonormal columns that span the block beyond the basis; directions shorter than ``least`` are dropped."""
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    if basis is not None and u.shape[1]:
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
    return u


def pca_fit_wide(df: DataFrame, vector: str, n_components: int, oversample: int = 8, tolerance: float = 1e-9, max_rounds: int = 200, seed: int = 0) -> Pca:
    """Leading principal components as ``pca_fit`` gives them (same signs); ``ratio`` has their shares of the total variance only.

    The search ends when no wanted component v has |C·v − λ·v| above ``tolerance`` times the largest λ, or raises after ``max_rounds``
    passes. Rows without a vector do not count. D times the block width must fit the size limit of a broadcast."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    if not n:
        raise ValueError("no vectors")
    mean = _sum_row(rows, "v") / n
    dim = len(mean)
    if n_components > dim:
        raise ValueError("more components than dimensions")
    width = min(dim, n_components + oversample)
    if dim * width > BROADCAST_CELLS:
        raise ValueError(f"{dim} x {width} numbers are too many to send to every task; ask for fewer components")
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    basis = image = np.zeros((dim, 0))
    for _ in range(max_rounds):
        product, variance = _covariance_times(rows, mean, block, n)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best = turn[:, :width]
        rest = image @ best - (basis @ best) * values[:width]
        top = max(float(values[0]), 0.0)
        if np.linalg.norm(rest[:, :n_components], axis=0).max() <= tolerance * top:
            break
        block = _orthonormal(rest, basis, 1e-14 * top)[:, : dim - basis.shape[1]]
        if not block.shape[1]:
            break
        if basis.shape[1] + width > BLOCKS_KEPT * width:
            kept = turn[:, : 2 * width]
            basis, image = basis @ kept, image @ kept
    else:
        raise ValueError(f"no convergence in {max_rounds} rounds; raise oversample or tolerance")
    found = (basis @ turn[:, :n_components]).T
    peak = found[np.arange(n_components), np.abs(found).argmax(axis=1)]
    found = found * np.where(peak < 0, -1.0, 1.0)[:, None]
    shares = np.maximum(values[:n_components], 0.0)
    return Pca(found, mean, shares / variance if variance else shares)
