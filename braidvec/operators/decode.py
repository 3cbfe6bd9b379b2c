"""Decoding vectors back into counts, and ranking candidate graphs, as table jobs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidvec.functions import batch as B
from braidvec.functions import vsa as V
from braidvec.functions.features import feature_tuple
from braidvec.functions.hashing import keyed_md5, unit_uniform
from braidvec.operators.codebook import Codebook
from braidvec.operators.bundling import rows_of
from braidvec.operators.decode_wide import decode_pairs_by_rounds, decode_pairs_in_tasks, exchanged, fitted, pair_blocks
from braidvec.operators.encode import GRAPH_LIMIT, edge_pairs, edge_terms, encode, node_terms
from braidvec.operators.graphs import components, double_edges, draw_class, graph_hash
from braidvec.operators.matchings import matching_task
from braidvec.plans.skew import few_keys, graph_sizes, if_small, per_graph, split_large, with_group_rank
from braidvec.schema import EncoderConfig
from braidvec.session import BROADCAST_CELLS, cut_lineage

# ---------------------------------------------------------------- codebook products inside tasks


# Vectors, and codebook numbers, that a task holds where the codebook cannot be sent whole.
GROUP_ROWS = 1 << 14
BLOCK_CELLS = 1 << 22


def _block_rows(codebook: Codebook, cells: int) -> int:
    return max(cells // (codebook.dim * (2 if V.is_complex(codebook.vsa) else 1)), 1)


def codebook_blocks(codebook: Codebook) -> list[Codebook]:
    """The codebook itself when it may be sent whole, otherwise consecutive index ranges that may."""
    if codebook.fits:
        return [codebook]
    from dataclasses import replace

    step = _block_rows(codebook, BROADCAST_CELLS)
    top = math.prod(codebook.bins)
    return [
        replace(codebook, table=codebook.table.filter((F.col("idx") >= lo) & (F.col("idx") < lo + step)), rows=step)
        for lo in range(0, top, step)
    ]


def _tiles(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    step = max(B.CELLS_PER_CHUNK // max(rows, 1), 1)
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def _over_blocks(df: DataFrame, codebook: Codebook, job: Callable, schema: str) -> DataFrame:
    """``job(known idx, matrix)`` run on Arrow batches against the whole codebook.

    A codebook that fits is sent to every task. One of any other size meets the vectors on a grid: the vectors are cut into groups of
    about GROUP_ROWS, the codebook into ranges of at most BLOCK_CELLS numbers, and a task holds one of each; the driver sees neither."""
    if codebook.fits:
        return df.mapInArrow(job(_sent_rows(codebook)), schema)
    vsa, dim = codebook.vsa, codebook.dim
    step = _block_rows(codebook, min(BLOCK_CELLS, BROADCAST_CELLS))
    numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    groups, blocks = max(1, -(-numbered.count() // GROUP_ROWS)), -(-math.prod(codebook.bins) // step)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = numbered.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")).drop("_row").withColumn("_k", every(blocks))
    right = codebook.table.select("idx", "hv", F.floor(F.col("idx") / step).cast("int").alias("_k")).withColumn("_g", every(groups))
    names = df.columns
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def cell(vectors: pa.Table, book: pa.Table) -> pa.Table:
        book = book.sort_by("idx").combine_chunks()
        found = []
        if vectors.num_rows and book.num_rows:
            batch = book.to_batches()[0]
            values = B.vector_rows(batch.column("hv"))
            half = np.iscomplexobj(values) and vsa == "HRR"  # already a spectrum
            matrix = B.from_engine(values[:, : dim // 2 + 1] if half else B.to_engine(values, vsa), vsa, dim)
            sent = SimpleNamespace(value=(batch.column("idx").to_numpy(zero_copy_only=False).astype(np.int64), matrix))
            found = list(job(sent)(iter(vectors.select(names).combine_chunks().to_batches())))
        return pa.Table.from_batches(found) if found else empty

    return left.groupBy("_g", "_k").cogroup(right.groupBy("_g", "_k")).applyInArrow(cell, schema)


def decode_counts(embeddings: DataFrame, codebook: Codebook, key: str = "graph_id", vector: str = "node_terms") -> DataFrame:
    """(key, idx, cnt): rounded inner product with every codebook row, kept when positive."""
    kind = embeddings.schema[key].dataType.simpleString()
    return _over_blocks(embeddings.select(key, F.col(vector).alias("v")), codebook, _counts_job(codebook, key, "v"), f"{key} {kind}, idx long, cnt long")


def decode_counts_of_nodes(nodes: DataFrame, codebook: Codebook, parts: int = 0) -> DataFrame:
    """``decode_counts(node_terms(nodes))``, decoded by the tasks that make the vectors where the codebook fits them."""
    if not codebook.fits:
        return decode_counts(node_terms(nodes, codebook), codebook)
    kind = nodes.schema["graph_id"].dataType.simpleString()
    return node_terms(nodes, codebook, (_counts_job(codebook, "graph_id", "node_terms")(_sent_rows(codebook)), f"graph_id {kind}, idx long, cnt long"), parts)


def _sent_rows(codebook: Codebook):
    """Broadcast (sorted idx, rows as stored) of a codebook that fits."""
    known, matrix = codebook.matrix()
    return codebook.table.sparkSession.sparkContext.broadcast((known, B.from_engine(matrix, codebook.vsa, codebook.dim)))


def _counts_job(codebook: Codebook, key: str, vector: str):
    scale = 1.0 if codebook.vsa == "HRR" else float(codebook.dim)

    def job(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, matrix = sent.value
            for whole in batches:
                for piece in _tiles(whole, len(known)):
                    products = (B.vector_rows(piece.column(vector)) @ matrix.conj().T).real
                    counts = np.rint(products / scale).astype(np.int64)
                    row, col = np.nonzero(counts > 0)
                    columns = [piece.column(key).take(pa.array(row)), pa.array(known[col]), pa.array(counts[row, col])]
                    yield pa.RecordBatch.from_arrays(columns, [key, "idx", "cnt"])

        return run

    return job


def nearest_entry(embeddings: DataFrame, codebook: Codebook, key: str = "graph_id", vector: str = "node_terms") -> DataFrame:
    """(key, idx, sim): codebook row of highest cosine; ties go to the lowest idx."""

    def job(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, matrix = sent.value
            lengths = np.maximum(np.linalg.norm(matrix, axis=1), V.EPSILON)
            for whole in batches:
                for piece in _tiles(whole, len(known)):
                    x = B.vector_rows(piece.column("v"))
                    sims = (x @ matrix.conj().T).real / lengths / np.maximum(np.linalg.norm(x, axis=1), V.EPSILON)[:, None]
                    best = _first_best(sims)
                    picked = sims[np.arange(len(x)), best]
                    columns = [piece.column(key), pa.array(known[best]), pa.array(picked)]
                    yield pa.RecordBatch.from_arrays(columns, [key, "idx", "sim"])

        return run

    kind = embeddings.schema[key].dataType.simpleString()
    out = _over_blocks(embeddings.select(key, F.col(vector).alias("v")), codebook, job, f"{key} {kind}, idx long, sim double")
    if codebook.fits:
        return out
    best = F.max_by(F.struct("idx", "sim"), F.struct(F.round("sim", 12), -F.col("idx")))
    return out.groupBy(key).agg(best.alias("_b")).select(key, "_b.idx", "_b.sim")


def _first_best(sims: np.ndarray) -> np.ndarray:
    """First position of the maximum per row; values that differ only by rounding noise count as equal."""
    if not sims.shape[1]:
        raise ValueError("empty codebook")
    return (sims >= sims.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)


# ---------------------------------------------------------------- peeling


# Codebook rows up to which their inner products are kept, and rounds after which running products are made anew.
GRAM_ROWS, FRESH_ROUNDS = 1 << 10, 16


def peel(x: np.ndarray, matrix: np.ndarray, most: int | None, eps: float) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Subtract the best codebook row from every vector until it is used up, stops shrinking, or has ``most`` rows (None: any).

    The picks, lengths and similarities of all vectors, each as (vector, value) by vector and in order."""
    lengths = np.maximum(np.linalg.norm(matrix, axis=1), V.EPSILON)
    other = matrix.conj().T
    gram = (matrix @ other).real if len(matrix) <= GRAM_ROWS else None
    rest, norm, active = x, np.linalg.norm(x, axis=1), np.arange(len(x))
    products, found = None, ([], [], [])
    for step in itertools.count() if most is None else range(most):
        found[1].append((active, norm))
        open_ = norm > eps
        active, rest, norm = active[open_], rest[open_], norm[open_]
        if not len(active):
            break
        products = (rest @ other).real if gram is None or step % FRESH_ROUNDS == 0 else products[open_]
        scores = products / lengths / np.maximum(norm, V.EPSILON)[:, None]
        best = _first_best(scores)
        after = rest - matrix[best]
        length = np.linalg.norm(after, axis=1)
        found[2].append((active, scores[np.arange(len(best)), best]))
        good = length < norm
        active, rest, norm, best = active[good], after[good], length[good], best[good]
        found[0].append((active, best))
        if gram is not None:
            products = products[good] - gram[best]
    return tuple(_by_vector(steps, kind) for steps, kind in zip(found, (np.int64, np.float64, np.float64), strict=True))


def _by_vector(steps: list[tuple[np.ndarray, np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray]:
    row = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in steps]])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([np.zeros(0, kind), *[v for _, v in steps]])[order]


def _lists(row: np.ndarray, values: np.ndarray, count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(count + 1)).astype(np.int32)), pa.array(values))


def decode_nodes_iterative(
    embeddings: DataFrame, codebook: Codebook, max_nodes: int | None = None, eps_share: float = 0.01, key: str = "graph_id", vector: str = "node_terms", debug: bool = False
) -> DataFrame:
    """(key, idx, cnt) by peeling; with ``debug`` one row per key with the picks, lengths and similarities in order.

    A vector is peeled until its remainder is small or no longer shrinks. ``max_nodes`` sets a bound in addition; the output
    then has a column ``capped`` that is true for keys that reached it. A codebook that may not be sent whole must be pruned
    to the tuples that occur for ``debug``; else it is searched in blocks (``decode_nodes_rounds``)."""
    if not codebook.fits:
        if debug:
            raise ValueError("debug needs a codebook that fits a task")
        return decode_nodes_rounds(embeddings, codebook, max_nodes, eps_share, key, vector)
    run, tail = _nodes_job(codebook, max_nodes, eps_share, key, "v", debug)
    kind = embeddings.schema[key].dataType.simpleString()
    return embeddings.select(key, F.col(vector).alias("v")).mapInArrow(run, f"{key} {kind}, {tail}")


def decode_nodes_iterative_of(nodes: DataFrame, codebook: Codebook, max_nodes: int | None = None, eps_share: float = 0.01, debug: bool = False, parts: int = 0) -> DataFrame:
    """``decode_nodes_iterative(node_terms(nodes))``, peeled by the tasks that make the vectors where the codebook fits them."""
    if not codebook.fits:
        return decode_nodes_iterative(node_terms(nodes, codebook), codebook, max_nodes, eps_share, debug=debug)
    run, tail = _nodes_job(codebook, max_nodes, eps_share, "graph_id", "node_terms", debug)
    kind = nodes.schema["graph_id"].dataType.simpleString()
    return node_terms(nodes, codebook, (run, f"graph_id {kind}, {tail}"), parts)


def _nodes_job(codebook: Codebook, max_nodes: int | None, eps_share: float, key: str, vector: str, debug: bool):
    """The peeling on Arrow batches of (key, vector), and the columns it adds to the key."""
    sent = _sent_rows(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = sent.value
        eps = eps_share * float(np.linalg.norm(matrix, axis=1).min())
        for whole in batches:
            for piece in _tiles(whole, max(len(known), 4 * matrix.shape[1])):
                n = piece.num_rows
                picks, norms, sims = peel(B.vector_rows(piece.column(vector)), matrix, max_nodes, eps)
                full = np.bincount(picks[0], minlength=n) >= (np.inf if max_nodes is None else max_nodes)
                more = [] if max_nodes is None else ["capped"]
                if debug:
                    columns = [piece.column(key), _lists(picks[0], known[picks[1]], n), _lists(*norms, n), _lists(*sims, n)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(full)] * len(more), [key, "picks", "norms", "sims", *more])
                    continue
                entry, cnt = np.unique(picks[0] * len(known) + picks[1], return_counts=True)
                rows, idx = np.divmod(entry, max(len(known), 1))
                columns = [piece.column(key).take(pa.array(rows)), pa.array(known[idx]), pa.array(cnt)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(full[rows])] * len(more), [key, "idx", "cnt", *more])

    tail = ("picks array<long>, norms array<double>, sims array<double>" if debug else "idx long, cnt long") + (", capped boolean" if max_nodes is not None else "")
    return run, tail


def decode_nodes_rounds(embeddings: DataFrame, codebook: Codebook, max_nodes: int | None = None, eps_share: float = 0.01, key: str = "graph_id", vector: str = "node_terms") -> DataFrame:
    """The same peeling for a codebook of any size: each round is a search over codebook blocks and a join."""
    if codebook.vsa == "FHRR":
        raise ValueError("prune the codebook before peeling complex vectors")
    table = codebook.table.select("idx", F.col("hv").alias("_hv"))
    eps = eps_share * table.agg(F.min(V.norm("_hv"))).first()[0]
    state = cut_lineage(embeddings.select(key, F.col(vector).alias("_v"), V.norm(vector).alias("_n")))
    picked = None
    for _ in itertools.count() if max_nodes is None else range(max_nodes):
        open_rows = state.filter(F.col("_n") > eps)
        if not open_rows.head(1):
            break
        best = nearest_entry(open_rows, codebook, key, "_v").select(key, "idx").join(table, "idx")
        after = open_rows.join(best, key).withColumn("_a", F.zip_with("_v", "_hv", lambda x, y: x - y))
        after = cut_lineage(after.withColumn("_m", V.norm("_a")).filter(F.col("_m") < F.col("_n")))
        found = after.select(key, "idx")
        picked = found if picked is None else picked.unionByName(found)
        state = after.select(key, F.col("_a").alias("_v"), F.col("_m").alias("_n"))
    if picked is None:
        picked = embeddings.select(key, F.lit(0).cast("long").alias("idx")).limit(0)
    counted = picked.groupBy(key, "idx").agg(F.count("*").alias("cnt"))
    if max_nodes is None:
        return counted
    total = counted.groupBy(key).agg((F.sum("cnt") >= max_nodes).alias("capped"))
    return counted.join(total, key)


def _pair_lengths(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    square = B.squares(matrix)
    return np.maximum(np.sqrt((square * weights) @ square.T), V.EPSILON)


def _real_parts(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values.real, values.imag], axis=-1) if np.iscomplexobj(values) else values


# Numbers of the bound vectors of all allowed pairs, up to which a task keeps them.
PAIR_CELLS = 1 << 22


def bound_pairs(matrix: np.ndarray, allowed: np.ndarray | None, weights: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(a, b, bound vectors as columns, lengths) of the allowed pairs a <= b, if they may be kept."""
    if allowed is None or np.count_nonzero(allowed) * matrix.shape[1] > PAIR_CELLS:
        return None
    a, b = np.nonzero(np.triu(allowed))
    return a, b, np.ascontiguousarray(_real_parts((matrix[a] * matrix[b]).conj()).T), _pair_lengths(matrix, weights)[a, b]


def peel_pairs(
    e: np.ndarray, matrix: np.ndarray, allowed: np.ndarray | None, rounds: np.ndarray | None, weights: np.ndarray, eps: np.ndarray | None, kept: tuple[np.ndarray, ...] | None = None
) -> list[list[tuple[int, int]]]:
    """Pairs of every vector of ``e``, best first, both directions subtracted; all vectors advance together.

    ``matrix`` is (vectors, tuples, dim), or (1, tuples, dim) when they share their tuples. ``rounds`` bounds the pairs of each
    vector; with ``eps`` a vector also stops when its remainder is below it or no longer shrinks. The products with bind(a, b)
    for all tuples a, b are one matrix product; the bound vectors are never formed, unless the few that are allowed are given by
    ``kept`` (``bound_pairs``).

    A wrong pair that was taken once stays, and leaves a remainder. The pairs of such vectors (few) are exchanged until nothing is left,
    or else the vectors are fitted again with free counts, and where whole counts leave nothing these are the answer; a vector that
    neither explains keeps its peeled pairs."""
    found: list[list[tuple[int, int]]] = [[] for _ in e]
    if not len(e) or not matrix.shape[1]:
        return found
    shared = len(matrix) == 1
    lengths = np.stack([_pair_lengths(m, weights) for m in matrix])
    given, e, norm = e, e.copy(), np.sqrt(B.squares(e) @ weights)
    active, size = np.arange(len(e)), matrix.shape[1]
    # The real part of a product of complex numbers as one real product of twice the length.
    columns = None if kept else np.ascontiguousarray(_real_parts(matrix.conj()).transpose(0, 2, 1))
    while True:
        if rounds is not None:
            active = active[np.array([len(found[k]) for k in active], np.int64) < rounds[active]]
        if eps is not None:
            active = active[norm[active] > eps]
        if not len(active):
            break
        if kept is not None:
            flat = _real_parts(e[active].conj() * weights) @ kept[2]
            flat /= kept[3]
        else:
            m = matrix if shared else matrix[active]
            halves = _real_parts((e[active].conj() * weights)[:, None, :] * m)
            sims = (halves.reshape(-1, halves.shape[2]) @ columns[0]).reshape(len(active), size, size) if shared else halves @ columns[active]
            sims /= lengths if shared else lengths[active]
            if allowed is not None:
                sims = np.where(allowed, sims, -np.inf)
            flat = sims.reshape(len(active), -1)
        best = (flat >= flat.max(1, keepdims=True) - 1e-12 * np.maximum(1.0, norm[active])[:, None]).argmax(1)
        a, b = np.divmod(best, size) if kept is None else (kept[0][best], kept[1][best])
        own = np.zeros(len(active), np.int64) if shared else active
        after = e[active] - 2 * matrix[own, a] * matrix[own, b]
        length = np.sqrt(B.squares(after) @ weights)
        good = np.ones(len(active), bool) if eps is None else length < norm[active]
        for k, x, y in zip(active[good], a[good], b[good], strict=True):
            found[k].append((int(x), int(y)))
        active, after, length = active[good], after[good], length[good]
        e[active], norm[active] = after, length
    upper = np.triu(np.ones((size, size), bool) if allowed is None else allowed)
    least = 0.02 * lengths[:, upper].min(1, initial=np.inf) if eps is None else np.full(1, eps)
    bound = np.full(len(given), np.iinfo(np.int64).max) if rounds is None else rounds
    unsettled = norm > least
    if eps is not None:  # a vector that was stopped at its bound has more pairs than it may give
        unsettled &= np.array([len(p) for p in found]) < bound
    for k in np.flatnonzero(unsettled):
        m, size_of, rest_of = matrix[0 if shared else k], lengths[0 if shared else k], least[k if len(least) > 1 else 0]

        def products(rest: np.ndarray, m=m) -> np.ndarray:
            return 2 * (((rest.conj() * weights) * m) @ m.T).real.ravel()

        def next_pair(rest: np.ndarray, free: np.ndarray, products=products, size_of=size_of) -> int:
            return int(np.where(free, products(rest) / size_of.ravel(), -np.inf).argmax())

        def atoms(at: list[int], m=m) -> np.ndarray:
            ends = np.array(at, np.int64)
            return 2 * m[ends // size] * m[ends % size]

        peeled = [min(x, y) * size + max(x, y) for x, y in found[k]]
        better = exchanged(given[k], peeled, products, atoms, np.where(upper, 4 * size_of**2, np.inf).ravel(), weights, rest_of, int(bound[k]))
        if better is None:
            better = fitted(given[k], next_pair, atoms, upper.ravel(), weights, rest_of, int(bound[k]))
        found[k] = found[k] if better is None else [divmod(at, size) for at in better]
    return found


def _pair_rows(key: str, owners: pa.Array, found: list[list[tuple[int, int]]], names: list[np.ndarray]) -> pa.RecordBatch:
    rows, left, right = [], [], []
    for row, pairs in enumerate(found):
        for a, b in pairs:
            rows += [row, row]
            left += [int(names[row][a]), int(names[row][b])]
            right += [int(names[row][b]), int(names[row][a])]
    columns = [owners.take(pa.array(rows, pa.int64())), pa.array(left, pa.int64()), pa.array(right, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [key, "a", "b"])


def _own_vectors(counts: DataFrame, codebook: Codebook, key: str) -> DataFrame:
    """(key, ids, hvs) for a codebook that may not be sent whole: every key brings the vectors of its own tuples."""
    own = counts.select(key, "idx").distinct().join(codebook.table.select("idx", "hv"), "idx", "left")
    checked = F.when(F.col("hv").isNull(), F.raise_error(F.lit("a feature index is not in the codebook"))).otherwise(F.col("hv"))
    lists = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", checked.alias("hv")))).alias("_l"))
    return lists.select(key, F.col("_l.idx").alias("ids"), F.col("_l.hv").alias("hvs"))


def decode_edges(embeddings: DataFrame, counts: DataFrame, codebook: Codebook, key: str = "graph_id", vector: str = "edge_terms") -> DataFrame:
    """(key, a, b, cnt) from edge vectors and decoded node counts (key, idx, cnt): ⌊Σ degree·cnt / 2⌋ rounds over the
    pairs of decoded tuples. The list of a key has at most one entry per codebook row. An id outside the codebook is an error."""
    weights = B.measure(codebook.vsa, codebook.dim)
    degree = feature_tuple("idx", codebook.bins)[1] + 1
    lists = counts.groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("ids"), F.sum(degree * F.col("cnt")).alias("total"))
    rows = embeddings.select(key, F.col(vector).alias("v")).join(lists, key)
    vsa, fits = codebook.vsa, codebook.fits
    if fits:
        sent = embeddings.sparkSession.sparkContext.broadcast(codebook.matrix())
    else:
        sent = None
        rows = rows.drop("ids").join(_own_vectors(counts, codebook, key), key).select(key, "v", "ids", "total", "hvs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = B.to_engine(B.vector_rows(batch.column("v")), vsa)
            names, rounds = _names_and_rounds(batch)

            def vectors(some: np.ndarray, batch=batch, names=names) -> np.ndarray:
                if fits:
                    known, matrix = sent.value
                    return matrix[rows_of(known, np.concatenate([names[k] for k in some]))]
                return np.concatenate([B.to_engine(B.vector_rows(batch.column("hvs")[int(k)].values), vsa) for k in some])

            yield _pair_rows(key, batch.column(key), _peeled_in_groups(x, names, rounds, vectors, weights), names)

    kind = embeddings.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, a long, b long").groupBy(key, "a", "b").agg(F.count("*").alias("cnt"))


def _names_and_rounds(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.array(ids, np.int64) for ids in batch.column("ids").to_pylist()], np.array(batch.column("total").to_pylist(), np.int64) // 2


def _peeled_in_groups(x: np.ndarray, names: list[np.ndarray], rounds: np.ndarray, vectors: Callable[[np.ndarray], np.ndarray], weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Pairs of every vector over its own tuples, vectors of as many tuples together."""
    found: list[list[tuple[int, int]]] = [[] for _ in names]
    sizes = np.array([len(ids) for ids in names], np.int64)
    for size in np.unique(sizes[sizes > 0]):
        group = np.flatnonzero(sizes == size)
        step = max(1, B.CELLS_PER_CHUNK // int(size * max(x.shape[1], size)))
        for low in range(0, len(group), step):
            some = group[low : low + step]
            pairs = peel_pairs(x[some], vectors(some).reshape(len(some), size, -1), None, rounds[some], weights, None)
            for k, p in zip(some, pairs, strict=True):
                found[k] = p
    return found


def _counted(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Equal rows with their number ``cnt``, where all rows of a key are in the batch."""
    names = rows.schema.names
    yield from pa.Table.from_batches([rows]).group_by(names, use_threads=False).aggregate([([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "cnt"]).to_batches()


def decode_edges_of(nodes: DataFrame, edges: DataFrame, counts: DataFrame, codebook: Codebook, limit: int = GRAPH_LIMIT) -> DataFrame:
    """``decode_edges(edge_terms(nodes, edges), counts)``. The vectors of graphs up to the size limit are made in the tasks that decode
    them, and do not leave these."""
    if not codebook.fits:
        return decode_edges(edge_terms(nodes, edges, codebook), counts, codebook)
    weights = B.measure(codebook.vsa, codebook.dim)
    sent = nodes.sparkSession.sparkContext.broadcast(codebook.matrix())
    degree = feature_tuple("idx", codebook.bins)[1] + 1
    lists = counts.groupBy("graph_id").agg(F.array_sort(F.collect_set("idx")).alias("ids"), F.sum(degree * F.col("cnt")).alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = sent.value
        for whole in batches:
            size = np.maximum(whole.column("_p").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 1)
            group = np.cumsum(size) * matrix.shape[1] // B.CELLS_PER_CHUNK
            cuts = np.searchsorted(group, np.unique(group))
            for low, high in zip(cuts, [*cuts[1:], whole.num_rows], strict=True):
                batch = whole.slice(low, high - low)
                held = batch.column("_p")
                flat = held.flatten()
                a, b = (rows_of(known, flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)) for c in ("a", "b"))
                owner = np.repeat(np.arange(batch.num_rows), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                x = B.segment_sum(matrix[a] * matrix[b], owner, batch.num_rows)
                names, rounds = _names_and_rounds(batch)
                found = _peeled_in_groups(x, names, rounds, lambda some, names=names: matrix[rows_of(known, np.concatenate([names[k] for k in some]))], weights)
                yield from _counted(_pair_rows("graph_id", batch.column("graph_id"), found, names))

    def job(part_nodes: DataFrame, part_edges: DataFrame, whole: bool) -> DataFrame:
        if not whole:
            return decode_edges(edge_terms(part_nodes, part_edges, codebook), counts, codebook)
        pairs = edge_pairs(part_nodes, part_edges, codebook.bins).groupBy("graph_id").agg(F.collect_list(F.struct("a", "b")).alias("_p"))
        mine = part_nodes.select("graph_id").distinct().join(lists, "graph_id").join(pairs, "graph_id", "left")
        kind = nodes.schema["graph_id"].dataType.simpleString()
        return mine.select("graph_id", "ids", "total", "_p").mapInArrow(run, f"graph_id {kind}, a long, b long, cnt long")

    return per_graph(nodes, edges, job, limit)


def decode_edges_free(embeddings: DataFrame, codebook: Codebook, limit: int | None = None, pairs: DataFrame | None = None, key: str = "graph_id", vector: str = "edge_terms") -> DataFrame:
    """(key, a, b, cnt) without node counts: all pairs of the codebook, or only the given ones (a, b). Vectors are peeled until
    the remainder is small or no longer shrinks; ``limit`` sets a bound on directed edges in addition (an odd one is rounded
    down), and the output then has a column ``capped``."""
    if not _searched_whole(codebook):
        rows = embeddings.select(key, F.col(vector).alias("v"))
        blocks = None if pairs is None else pair_blocks(pairs, codebook, BROADCAST_CELLS)
        if blocks is not None and len(blocks) == 1:
            found = decode_pairs_in_tasks(rows, blocks[0], codebook, limit, key)
        else:
            found = decode_pairs_by_rounds(rows, codebook, blocks, limit, key)
        counted = found.groupBy(key, "a", "b").agg(F.count("*").alias("cnt"))
        if limit is None:
            return counted
        total = counted.groupBy(key).agg((F.sum("cnt") >= limit // 2 * 2).alias("capped"))
        return counted.join(total, key).select(key, "a", "b", "capped", "cnt")
    run, tail, more = _free_job(codebook, limit, pairs, key, "v")
    kind = embeddings.schema[key].dataType.simpleString()
    rows = embeddings.select(key, F.col(vector).alias("v")).mapInArrow(run, f"{key} {kind}, a long, b long{tail}")
    return rows.groupBy(key, "a", "b", *more).agg(F.count("*").alias("cnt"))


def _searched_whole(codebook: Codebook) -> bool:
    return codebook.fits and codebook.rows**2 <= BROADCAST_CELLS


def decode_edges_free_of(nodes: DataFrame, edges: DataFrame, codebook: Codebook, limit: int | None = None, pairs: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """``decode_edges_free(edge_terms(nodes, edges))``, decoded by the tasks that make the vectors where the codebook allows that."""
    if not _searched_whole(codebook):
        return decode_edges_free(edge_terms(nodes, edges, codebook), codebook, limit, pairs)
    run, tail, _ = _free_job(codebook, limit, pairs, "graph_id", "edge_terms")
    kind = nodes.schema["graph_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            yield from _counted(rows)

    return edge_terms(nodes, edges, codebook, (counted, f"graph_id {kind}, a long, b long{tail}, cnt long"), parts)


def _free_job(codebook: Codebook, limit: int | None, pairs: DataFrame | None, key: str, vector: str):
    """The peeling on Arrow batches of (key, vector), the columns it adds to the key and the pair, and their names. All rows of a vector
    come in one batch."""
    weights, vsa = B.measure(codebook.vsa, codebook.dim), codebook.vsa
    known, matrix = codebook.matrix()
    allowed = None
    if pairs is not None:
        seen = pairs.select("a", "b").distinct().toPandas()  # no more than the pairs just checked
        allowed = np.zeros((len(known), len(known)), bool)
        a, b = rows_of(known, seen["a"].to_numpy()), rows_of(known, seen["b"].to_numpy())
        allowed[a, b] = allowed[b, a] = True
        # Tuples that are in no pair are not searched.
        used = allowed.any(1)
        known, matrix, allowed = known[used], matrix[used], allowed[np.ix_(used, used)]
    sent = codebook.table.sparkSession.sparkContext.broadcast((known, matrix, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix, allowed = sent.value
        lengths = _pair_lengths(matrix, weights)
        eps = 0.01 * 2 * float(lengths.min() if allowed is None else lengths[allowed].min()) if lengths.size else 0.0
        kept = bound_pairs(matrix, allowed, weights)
        step = max(1, B.CELLS_PER_CHUNK // max(1, len(known) * max(matrix.shape[1], len(known)) if kept is None else max(2 * matrix.shape[1], len(kept[0]))))
        for batch in batches:
            x = B.to_engine(B.vector_rows(batch.column(vector)), vsa)
            for low in range(0, len(x), step):
                some = x[low : low + step]
                rounds = None if limit is None else np.full(len(some), limit // 2)
                found = peel_pairs(some, matrix[None], allowed, rounds, weights, eps, kept)
                out = _pair_rows(key, batch.column(key).slice(low, step), found, [known] * len(found))
                if limit is not None:
                    full = np.repeat([len(p) >= limit // 2 for p in found], [2 * len(p) for p in found])
                    out = pa.RecordBatch.from_arrays([*out.columns, pa.array(full.astype(bool))], [*out.schema.names, "capped"])
                yield out

    return run, *((", capped boolean", ["capped"]) if limit is not None else ("", []))


# ---------------------------------------------------------------- consistency of decoded edges


def node_counts_from_edges(edges: DataFrame, bins: Sequence[int], method: str = "floor", key: str = "graph_id") -> DataFrame:
    """(key, idx, cnt): directed edges per source tuple over its degree, rounded down or up."""
    stubs = edges.groupBy(key, F.col("a").alias("idx")).agg(F.sum("cnt").alias("stubs"))
    share = F.col("stubs") / (feature_tuple("idx", bins)[1] + 1)
    rounded = F.ceil(share) if method == "ceil" else F.floor(share)
    return stubs.select(key, "idx", rounded.cast("long").alias("cnt"))


def target_reached(edges: DataFrame, bins: Sequence[int], keys: DataFrame, key: str = "graph_id") -> DataFrame:
    """Whether the directed edges use up exactly the degrees of the implied nodes; false without edges."""
    stubs = edges.groupBy(key, F.col("a").alias("idx")).agg(F.sum("cnt").alias("stubs"))
    degree = feature_tuple("idx", bins)[1] + 1
    used = F.floor(F.col("stubs") / degree) * degree
    out = stubs.groupBy(key).agg((F.sum("stubs") == F.sum(used)).alias("reached"))
    return keys.select(key).distinct().join(out, key, "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def degree_gap(number: Column | str, base: Column | str) -> Column:
    """(extra, missing): units by which a fractional count is above its floor and below its ceiling."""
    n = F.col(number) if isinstance(number, str) else number
    b = F.col(base) if isinstance(base, str) else base
    extra, missing = n - F.floor(n), F.ceil(n) - n
    return F.struct(F.rint(extra / b).cast("long").alias("extra"), F.rint(missing / b).cast("long").alias("missing"))


# Types of a key up to which all of them are paired with each other.
MANY_TYPES = 1000


def pairing_possible(stubs: DataFrame, valid_pairs: DataFrame, key: str = "graph_id") -> DataFrame:
    """Whether every stub type (key, idx, cnt) has enough valid partners; a type meets itself one time less."""
    both = valid_pairs.select("a", "b").unionByName(valid_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    partners = lambda some: some.select(key, F.col("idx").alias("b"), F.col("cnt").alias("_have"))
    own = lambda some: some.select(key, F.col("idx").alias("a"))
    # The types of a key meet each other where the key is; only a key of very many types is joined through the pairs.
    large = few_keys(stubs.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > MANY_TYPES).select(key))
    small, big = split_large(stubs, large, [key])
    options = own(small).join(partners(small), key).join(if_small(cut_lineage(both)), ["a", "b"], "left_semi")
    if big is not None:
        options = options.unionByName(own(big).join(both, "a").join(partners(big), [key, "b"]))
    have = F.sum(F.when(F.col("a") == F.col("b"), F.col("_have") - 1).otherwise(F.col("_have")))
    available = options.groupBy(key, F.col("a").alias("idx")).agg(have.alias("_available"))
    joined = stubs.join(available, [key, "idx"], "left")
    return joined.groupBy(key).agg(F.bool_and(F.coalesce("_available", F.lit(0)) >= F.col("cnt")).alias("possible"))


def halve_edges(edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, a, b, cnt) with a ≤ b: every second row of the sorted list of ordered edges.

    The list is kept as counts. How many of a run of equal rows stay follows from the number of rows before the run, so
    a graph needs one row per distinct pair and no list."""
    ordered = edges.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cnt")
    runs = ordered.groupBy(key, "a", "b").agg(F.sum("cnt").alias("cnt"))
    window = Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("cnt").over(window)
    kept = F.floor((F.col("_end") + 1) / 2) - F.floor((F.col("_end") - F.col("cnt") + 1) / 2)
    return runs.withColumn("_end", end).select(key, "a", "b", kept.cast("long").alias("cnt")).filter("cnt > 0")


def sample_matchings(edges: DataFrame, bins: Sequence[int], n: int, seed: int, key: str = "graph_id", distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Random stub matchings of decoded edges: (candidate nodes, candidate edges), connected and loop-free ones only.

    For each sample and tuple the edge ends are put in hash order and meet the node stubs of that tuple in turn.
    Candidates have graph_id = query · n + sample and ``query_id``. The pairs of a query are brought together once, and its samples
    are made, checked and written in one task; a query of more than GRAPH_LIMIT edge ends takes joins instead. With ``distinct``
    most samples that repeat an earlier one of their query, edge by edge, are left out."""
    sizes = edges.groupBy(key).agg(F.sum("cnt").alias("_n"))
    large = few_keys(sizes.filter(F.col("_n") > GRAPH_LIMIT).select(key))
    small, big = split_large(edges, large, [key])
    lists = small.groupBy(key).agg(F.collect_list(F.struct("a", "b", "cnt")).alias("_pairs"))
    lists = lists.select(key, F.col(key).cast("string").alias("_name"), "_pairs")
    kind = edges.schema[key].dataType.simpleString()
    rows = lambda part, columns: lists.mapInArrow(matching_task(key, bins, n, seed, part, distinct), f"query_id {kind}, graph_id long, {columns}")
    nodes = rows("nodes", "node_id int, idx long").select("query_id", "graph_id", "node_id", feature_tuple("idx", bins).alias("feat"))
    links = rows("edges", "src int, dst int")
    if big is None:
        return nodes, links
    more_nodes, more_links = _matchings_by_joins(big, bins, n, seed, key)
    return nodes.unionByName(more_nodes), links.unionByName(more_links)


def _matchings_by_joins(edges: DataFrame, bins: Sequence[int], n: int, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The same matchings for queries of any size."""
    half = halve_edges(edges, key)
    nodes = node_counts_from_edges(edges, bins, "floor", key)
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = (F.sum("cnt").over(before) - F.col("cnt")).alias("_first")
    nodes = nodes.filter("cnt > 0").select(key, "idx", "cnt", first, (feature_tuple("idx", bins)[1] + 1).alias("_deg"))
    stubs = nodes.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") * F.col("_deg") - 1)))
    stubs = stubs.select(key, "idx", "_at", (F.col("_first") + F.floor(F.col("_at") / F.col("_deg"))).cast("int").alias("node_id"))
    copies = half.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt"))))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("idx")), F.struct(F.lit(1).alias("side"), F.col("b").alias("idx")))
    ends = copies.select(key, "a", "b", "_copy", F.explode(ends).alias("_e")).select(key, "a", "b", "_copy", "_e.side", "_e.idx")
    drawn = ends.withColumn("_sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = keyed_md5(seed, F.col(key), F.col("_sample"), F.col("a"), F.col("b"), F.col("_copy"), F.col("side"))
    drawn = cut_lineage(drawn.withColumn("_h", order))
    turn = [F.col(c) for c in ("_h", "a", "b", "_copy", "side")]
    drawn = with_group_rank(drawn, [key, "_sample", "idx"], turn, "_at")
    matched = drawn.join(stubs, [key, "idx", "_at"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    joined = matched.groupBy(key, "_sample", "a", "b", "_copy").agg(side(0, "node_id").alias("src"), side(1, "node_id").alias("dst"))
    number = (F.col(key) * n + F.col("_sample")).cast("long")
    made = joined.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col(key).alias("query_id"), number.alias("graph_id"), "a", "b", "src", "dst")
    made = cut_lineage(made)
    looped = made.filter("src = dst").select("graph_id").distinct()
    whole = made.join(looped, "graph_id", "left_anti")
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("a").alias("idx")), F.struct(F.col("dst").alias("node_id"), F.col("b").alias("idx")))
    node_rows = whole.select("query_id", "graph_id", F.explode(ends).alias("_n")).select("query_id", "graph_id", "_n.node_id", "_n.idx").distinct()
    edge_rows = double_edges(whole.select("query_id", "graph_id", "src", "dst")).distinct()
    parts = components(node_rows, edge_rows).groupBy("graph_id").agg(F.count_if(F.col("label") == F.col("node_id")).alias("_c"))
    connected = parts.filter("_c = 1").select("graph_id")
    node_rows = node_rows.join(connected, "graph_id", "left_semi").withColumn("feat", feature_tuple("idx", bins))
    return node_rows.drop("idx"), edge_rows.join(connected, "graph_id", "left_semi")


# ---------------------------------------------------------------- candidates


def score_candidates(queries: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, codebook: Codebook | None = None, target: str = "graph") -> DataFrame:
    """(query_id, cand_id, wl, n, m, sim): candidates encoded and compared with their query's vector, equal structures of a query
    merged (the lowest id stays).

    ``queries`` has (query_id, vector); candidate tables carry query_id. ``target`` is the candidate's graph vector, or with
    "sum" the sum of its node, edge and graph vectors. The sizes of all candidates are counted once for hashing and encoding."""
    if target not in ("graph", "sum"):
        raise ValueError("target must be 'graph' or 'sum'")
    sizes = cut_lineage(graph_sizes(nodes, edges))
    owner = nodes.select("graph_id", "query_id").distinct()
    hashes = graph_hash(nodes, edges, sizes=sizes).join(owner, "graph_id")
    unique = cut_lineage(hashes.groupBy("query_id", "wl", "n", "m").agg(F.min("graph_id").alias("graph_id")))
    kept = unique.select("graph_id")
    encoded = encode(nodes.join(kept, "graph_id", "left_semi"), edges.join(kept, "graph_id", "left_semi"), cfg, codebook, sizes=sizes)
    vector = F.col("graph_embedding")
    if target == "sum":
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        terms = [F.col(c) for c in ("node_terms", "edge_terms", "graph_embedding")]
        if cfg.vsa == "FHRR":
            vector = F.struct(*(add(add(terms[0][p], terms[1][p]), terms[2][p]).alias(p) for p in ("re", "im")))
        else:
            vector = add(add(terms[0], terms[1]), terms[2])
    scored = encoded.select("graph_id", vector.alias("_v")).join(unique, "graph_id").join(queries.select("query_id", "vector"), "query_id")
    return scored.select("query_id", F.col("graph_id").alias("cand_id"), "wl", "n", "m", V.cosine("_v", "vector").alias("sim"))


def rank_candidates(queries: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: EncoderConfig, top_k: int = 1, target: str = "graph") -> DataFrame:
    """(query_id, rank, cand_id, sim): the best of ``score_candidates``. The rank limit is applied before the shuffle."""
    scored = score_candidates(queries, nodes, edges, cfg, target=target).select("query_id", "cand_id", "sim")
    window = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "cand_id")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_k)


def prune_candidates(scored: DataFrame, beam: int, ratio: float, seed: int, by_size: bool = False) -> DataFrame:
    """Top int((1 − ratio)·beam) by similarity and int(ratio·beam) of the others in hash order, per query (and size).

    Both limits are row-number filters, which Spark applies in every task before the shuffle; a query with very many
    candidates sends only that many rows per task. The scored rows are written once and read by both."""
    scored = cut_lineage(scored)
    keys = ["query_id", "size"] if by_size else ["query_id"]
    keep, more = int((1 - ratio) * beam), int(ratio * beam)
    best = Window.partitionBy(*keys).orderBy(F.desc("sim"), "cand_id")
    top = scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= keep).drop("_r")
    if more == 0:
        return top
    rest = scored.join(top.select("query_id", "cand_id"), ["query_id", "cand_id"], "left_anti")
    order = Window.partitionBy(*keys).orderBy("_h", "cand_id")
    rest = rest.withColumn("_h", keyed_md5(seed, F.col("query_id"), F.col("cand_id")))
    rest = rest.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= more)
    return top.unionByName(rest.drop("_r", "_h"))


def residual_target(queries: DataFrame, leftovers: DataFrame, vector: str = "vector", key: str = "query_id") -> DataFrame:
    """Query vectors minus the vector of their left-over edges (key, edge_vector); unchanged where there is none."""
    joined = queries.join(leftovers.select(key, "edge_vector"), key, "left")
    less = F.zip_with(vector, "edge_vector", lambda x, y: x - y)
    return joined.withColumn(vector, F.when(F.col("edge_vector").isNull(), F.col(vector)).otherwise(less)).drop("edge_vector")


def best_of_n(scores: DataFrame, group: str, item: str, score: Column | str = "score") -> DataFrame:
    """Per group the item of lowest score (lowest item on ties) and the mean of the finite scores, infinity if none.

    ``score`` may be any column expression; lower is better. An item without a score, or without a name, comes after all others."""
    value = F.col(score) if isinstance(score, str) else score
    marked = scores.select(group, F.col(item).alias("_i"), value.cast("double").alias("_s"))
    finite = F.when(F.col("_s") < F.lit(math.inf), F.col("_s"))
    return marked.groupBy(group).agg(
        F.min_by("_i", F.struct(F.col("_s").isNull(), "_s", F.col("_i").isNull(), "_i")).alias("best_item"), F.min("_s").alias("best_score"),
        F.coalesce(F.avg(finite), F.lit(math.inf)).alias("avg_score"),
    )


def sample_edge_candidates(probabilities: DataFrame, k: int, seed: int, classes: int = 5) -> DataFrame:
    """k class draws per unordered pair from (graph_id, src, dst, probs), mirrored: (query_id, graph_id, src, dst, bond)
    with graph_id = query · k + sample and class 0 left out."""
    upper = probabilities.filter("src < dst").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    u = unit_uniform(keyed_md5(seed, F.col("graph_id"), F.col("_s"), F.col("src"), F.col("dst")))
    drawn = upper.select(
        F.col("graph_id").alias("query_id"), (F.col("graph_id") * k + F.col("_s")).cast("long").alias("graph_id"), "src", "dst",
        draw_class(F.col("probs"), u, classes).alias("bond"),
    )
    return double_edges(drawn.filter("bond > 0"))


