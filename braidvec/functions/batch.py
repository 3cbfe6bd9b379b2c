"""Small numpy helpers that run inside tasks on Arrow batches of whole (size-checked) graphs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CELLS_PER_CHUNK = 1 << 20  # vector cells handled at once: 8 MiB of doubles
CELLS_IN_CACHE = 1 << 18  # where several arrays of that size are passed over again and again


@dataclass
class FlatGraphs:
    """A batch of nested graphs as flat arrays; ``src`` and ``dst`` are row numbers into the node arrays."""

    count: int
    graph_of_node: np.ndarray
    graph_of_edge: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    node: dict[str, np.ndarray]
    edge: dict[str, np.ndarray]


def _list_parts(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    fields = {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}
    return np.repeat(np.arange(len(lengths)), lengths), fields


def flatten_graphs(batch: pa.RecordBatch) -> FlatGraphs:
    """Flatten the list columns ``nodes`` and ``edges`` and resolve edge ends to node rows; edges are sorted by source."""
    graph_of_node, node = _list_parts(batch.column("nodes"))
    graph_of_edge, edge = _list_parts(batch.column("edges"))
    ids = node["node_id"].astype(np.int64)
    low = ids.min(initial=0)
    span = max(int(ids.max(initial=0)) - int(low) + 1, 1)
    keys = graph_of_node * span + (ids - low)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    ends = []
    for name in ("src", "dst"):
        wanted = graph_of_edge * span + (edge[name].astype(np.int64) - low)
        at = np.searchsorted(ordered, wanted)
        if len(wanted) and (at.max(initial=0) >= len(ordered) or not np.array_equal(ordered[at], wanted)):
            raise ValueError("an edge names a node that its graph does not have")
        ends.append(order[at] if len(wanted) else at)
    by_source = np.argsort(ends[0], kind="stable")
    edge = {name: values[by_source] for name, values in edge.items()}
    return FlatGraphs(batch.num_rows, graph_of_node, graph_of_edge[by_source], ends[0][by_source], ends[1][by_source], node, edge)


def segment_sum(values: np.ndarray, segment: np.ndarray, count: int) -> np.ndarray:
    """Sum rows by segment number."""
    out = np.zeros((count, values.shape[1]), values.dtype)
    if len(segment):
        if (segment[1:] < segment[:-1]).any():
            order = np.argsort(segment, kind="stable")
            segment, values = segment[order], values[order]
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        out[segment[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def chunks(batch: pa.RecordBatch, dim: int, cells: int = CELLS_PER_CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch of graphs so that its vectors fit the cell budget (one graph at least)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in ("nodes", "edges"):
        sizes += batch.column(name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    budget = max(cells // dim, 1)
    begin = 0
    while begin < batch.num_rows:
        total = np.cumsum(sizes[begin:])
        take = max(int(np.searchsorted(total, budget, side="right")), 1)
        yield batch.slice(begin, take)
        begin += take


def measure(vsa: str, dim: int) -> np.ndarray:
    """Weights w with ‖v‖² = Σ w|x|² for the engine form x of a vector v. HRR keeps the first half of the spectrum of a real
    vector; by symmetry every position but the first (and the middle one) stands for two."""
    if vsa != "HRR":
        return np.ones(dim)
    weights = np.full(dim // 2 + 1, 2.0 / dim)
    weights[0] = 1.0 / dim
    if dim % 2 == 0:
        weights[-1] = 1.0 / dim
    return weights


def to_engine(values: np.ndarray, vsa: str) -> np.ndarray:
    """Stored vectors in the form in which they are bound: half spectra for HRR."""
    return np.fft.rfft(values, axis=1) if vsa == "HRR" else values


def from_engine(values: np.ndarray, vsa: str, dim: int) -> np.ndarray:
    """Inverse of ``to_engine``."""
    return np.fft.irfft(values, n=dim, axis=1) if vsa == "HRR" else values


def squares(values: np.ndarray) -> np.ndarray:
    """|x|² per entry."""
    return values.real**2 + values.imag**2 if np.iscomplexobj(values) else values**2


def unit_rows(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Divide rows by (length + 1e-8)."""
    return values / (np.sqrt(squares(values) @ weights) + 1e-8)[:, None]


def message_passing(
    flat: FlatGraphs, start: np.ndarray, depth: int, normalize: bool, weights: np.ndarray, isolated: str
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the node states over all layers, and the first bound layer before normalisation."""
    weight = flat.edge.get("weight")
    alone = np.ones(len(start), bool)
    alone[flat.src] = False
    state, total, first = start, start.copy(), np.zeros_like(start)
    for layer in range(depth):
        messages = state[flat.dst]
        if weight is not None:
            messages = messages * weight[:, None]
        gathered = segment_sum(messages, flat.src, len(start))
        if isolated == "identity":
            gathered[alone] = 1.0
        state = state * gathered
        if layer == 0:
            first = state
        if normalize:
            state = unit_rows(state, weights)
        total += state
    return total, first


def component_labels(flat: FlatGraphs) -> np.ndarray:
    """Smallest node row of each node's component: minimum label over neighbours with pointer jumping."""
    label = np.arange(len(flat.graph_of_node))
    while True:
        new = label.copy()
        np.minimum.at(new, flat.src, label[flat.dst])
        np.minimum.at(new, flat.dst, label[flat.src])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def pagerank_values(flat: FlatGraphs, damping: float, rounds: int) -> np.ndarray:
    """Power iteration per graph; nodes without edges spread their rank over their graph."""
    total = len(flat.graph_of_node)
    size = np.bincount(flat.graph_of_node, minlength=flat.count)[flat.graph_of_node]
    degree = np.bincount(flat.src, minlength=total)
    rank = 1.0 / size
    for _ in range(rounds):
        share = rank[flat.src] / degree[flat.src]
        received = np.bincount(flat.dst, weights=share, minlength=total)
        loose = np.bincount(flat.graph_of_node, weights=np.where(degree == 0, rank, 0.0), minlength=flat.count)
        rank = (1 - damping) / size + damping * (received + loose[flat.graph_of_node] / size)
    return rank


def return_probabilities(flat: FlatGraphs, ks: list[int]) -> np.ndarray:
    """Diagonal of (D⁻¹A)^k per node, for stacks of small graphs of equal size; 1.0 for a node without edges."""
    sizes = np.bincount(flat.graph_of_node, minlength=flat.count)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.ones((len(flat.graph_of_node), len(ks)))
    for n in np.unique(sizes[sizes > 0]):
        members = np.flatnonzero(sizes == n)
        slot = np.full(flat.count, -1)
        step_size = max(CELLS_PER_CHUNK // int(n * n), 1)
        for begin in range(0, len(members), step_size):
            group = members[begin : begin + step_size]
            slot[group] = np.arange(len(group))
            mine = np.flatnonzero(slot[flat.graph_of_edge] >= 0)
            owner = flat.graph_of_edge[mine]
            a = np.zeros((len(group), n, n))
            a[slot[owner], flat.src[mine] - first[owner], flat.dst[mine] - first[owner]] = 1.0
            a = np.maximum(a, a.transpose(0, 2, 1))
            degree = a.sum(axis=2)
            walk = a / np.maximum(degree, 1.0)[:, :, None]
            rows = first[group][:, None] + np.arange(n)
            alone = degree == 0
            power, done = walk, 1
            for i in sorted(range(len(ks)), key=lambda j: ks[j]):
                while done < ks[i]:
                    power, done = power @ walk, done + 1
                out[rows, i] = np.where(alone, 1.0, np.einsum("bii->bi", power))
            slot[group] = -1
    return out


def vector_column(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list<double> column; complex rows as struct<re, im>."""
    if np.iscomplexobj(values):
        return pa.StructArray.from_arrays([vector_column(values.real), vector_column(values.imag)], ["re", "im"])
    rows, dim = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def vector_rows(column: pa.Array) -> np.ndarray:
    """Matrix from a list<double> or struct<re, im> column of equally long vectors."""
    if pa.types.is_struct(column.type):
        return vector_rows(column.field("re")) + 1j * vector_rows(column.field("im"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))
