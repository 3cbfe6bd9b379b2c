"""Grouped sums of vectors that send one array a key and task.

``bundle`` adds whole arrays by key inside every task, as many keys at a time as fit a fixed number of cells, and exchanges the
partial sums once. ``sum_counted`` adds codebook rows (or bound pairs of them) by their counts: a task counts its own rows first and
then sends, per key, either the counted entries or, where that is shorter, their vector. As sums are linear, no task needs the counts
of the others, and what one key sends is bounded by a vector a task, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidvec.functions import batch as B
from braidvec.functions import vsa as V

# Vector cells that a task keeps as partial sums (8 bytes each, 16 for complex numbers).
HELD_CELLS = 1 << 22
# Rows that are counted together before anything is sent.
COUNTED_ROWS = 1 << 16
# Entries of a key up to which they are added place by place, which is faster than sums over segments.
STEPS = 32
# Groups of tasks whose partial sums are added before the last exchange of a tree.
TREE_GROUPS = 64
_ENTRY = np.dtype([("a", "<i4"), ("b", "<i4"), ("n", "<f8")])


def key_numbers(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every distinct key, key number of every row); null is a value of its own. Keys of one column are numbered in
    the order of their first rows."""
    number = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, number = np.unique(number * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return first, number


def _added(keys: pa.Table, values: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    first, number = key_numbers(keys.columns)
    return keys.take(pa.array(first)), B.segment_sum(values, number, len(first))


class _Combiner:
    """Partial sums of one task. Batches wait until they fill half the room, are added up, and leave when the sums fill it."""

    def __init__(self, keys: Sequence[str], hv: str, weight: str | None) -> None:
        self.keys, self.hv, self.weight = list(keys), hv, weight

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.Table, np.ndarray]] = []
        cells = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = B.vector_rows(batch.column(self.hv))
            if self.weight:
                values = values * batch.column(self.weight).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
            waiting.append(_added(pa.Table.from_batches([batch]).select(self.keys), values))
            cells += waiting[-1][1].size
            if cells > HELD_CELLS:
                waiting = [self._together(waiting)]
                cells = waiting[0][1].size
                if cells > HELD_CELLS // 2:  # few rows share a key: holding on gains nothing
                    yield from self._out(waiting)
                    waiting, cells = [], 0
        yield from self._out(waiting)

    @staticmethod
    def _together(waiting: list[tuple[pa.Table, np.ndarray]]) -> tuple[pa.Table, np.ndarray]:
        return _added(pa.concat_tables([k for k, _ in waiting]), np.concatenate([v for _, v in waiting]))

    def _out(self, waiting: list[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if waiting:
            keys, values = self._together(waiting)
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), B.vector_column(values)], [*self.keys, self.hv])


def _array_sum(lists: Column, field: str | None = None) -> Column:
    part = (lambda x: x[field]) if field else (lambda x: x)
    rest = F.transform(F.slice(lists, F.lit(2), F.greatest(F.size(lists) - 1, F.lit(0))), part)
    return F.aggregate(rest, part(lists[0]), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))


def _merged(partial: DataFrame, keys: Sequence[str], hv: str, complex_: bool) -> DataFrame:
    """Add the partial sums of each key: at most one a task, or one a group of tasks."""
    grouped = partial.groupBy(*keys).agg(F.collect_list(hv).alias("_lists"))
    lists = F.col("_lists")
    total = F.struct(_array_sum(lists, "re").alias("re"), _array_sum(lists, "im").alias("im")) if complex_ else _array_sum(lists)
    return grouped.select(*keys, total.alias(hv))


def bundle(df: DataFrame, keys: Sequence[str], hv: str = "hv", weight: str | None = None, tree: bool = False) -> DataFrame:
    """Element-wise (weighted) sum of equally long vectors per key; rows without a vector do not count. With ``tree``, for few
    keys of very many rows, the tasks' sums are first added in groups."""
    complex_ = df.schema[hv].dataType.typeName() == "struct"
    kind = V.COMPLEX_TYPE if complex_ else "array<double>"
    rows = df.filter(F.col(hv).isNotNull()).select(*keys, F.col(hv).cast(kind).alias(hv), *([weight] if weight else []))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{hv}` {kind}"])
    partial = rows.mapInArrow(_Combiner(keys, hv, weight), schema)
    if tree:
        salted = partial.withColumn("_salt", F.spark_partition_id() % TREE_GROUPS)
        partial = _merged(salted, [*keys, "_salt"], hv, complex_).drop("_salt")
    return _merged(partial, keys, hv, complex_)


# ---------------------------------------------------------------- sums of codebook rows


def _buffered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def sum_counted(counts: DataFrame, key: str, sent, out: str, pairs: bool, finish: Callable[[np.ndarray], pa.Array], kind: str, then: tuple[Callable, str] | None = None, parts: int = 0) -> DataFrame:
    """Σ n · row(a), or Σ n · row(a) · row(b) with ``pairs``, per key, from rows (key, a[, b], n); equal entries may come in
    several rows. ``sent`` is a broadcast (sorted idx, matrix) and ``finish`` turns sums into the column ``out`` of type ``kind``.

    With ``then`` = (job on batches, its schema) the sums go on to the job inside their task and do not leave it themselves. ``parts``
    is the least number of parts the keys are dealt into."""
    key_type = counts.schema[key].dataType.simpleString()

    def vectors(matrix: np.ndarray, entries: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sums of entries (rows of the matrix) by sorted owner, a bounded number of cells at a time."""
        total = np.zeros((n, matrix.shape[1]), matrix.dtype)
        step = max(1, B.CELLS_IN_CACHE // max(matrix.shape[1], 1))
        for low in range(0, len(entries), step):
            some, at = entries[low : low + step], owner[low : low + step]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            if place.max() >= STEPS:
                total[at[first]] += np.add.reduceat(rows(matrix, some), first, axis=0)
                continue
            for k in range(int(place.max()) + 1):  # the entries at place k belong to different keys
                mine = np.flatnonzero(place == k)
                total[at[mine]] += rows(matrix, some[mine])
        return total

    def rows(matrix: np.ndarray, some: np.ndarray) -> np.ndarray:
        values = matrix[some["a"]]
        if pairs:
            values *= matrix[some["b"]]
        if (some["n"] != 1).any():
            values *= some["n"][:, None]
        return values

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = sent.value
        names = [key, "entries", "vector"]
        held: tuple[pa.Table, np.ndarray] | None = None
        for table in _buffered(batches, COUNTED_ROWS):
            first, number = key_numbers([table.column(key)])
            entries = np.zeros(table.num_rows, _ENTRY)
            for name in ("a", "b")[: 1 + pairs]:
                entries[name] = rows_of(known, table.column(name).to_numpy())
            entries["n"] = table.column("n").cast(pa.float64()).to_numpy()
            order = np.lexsort((entries["b"], entries["a"], number))
            entries, number = entries[order], number[order]
            fresh = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])))
            total = np.add.reduceat(entries["n"], fresh)
            entries, number = entries[fresh], number[fresh]
            entries["n"] = total
            keys = table.select([key]).take(pa.array(first))
            size = np.bincount(number, minlength=len(first))
            large = size * _ENTRY.itemsize > matrix.shape[1] * matrix.itemsize
            if large.any():
                mine = large[number]
                more = keys.filter(pa.array(large)), vectors(matrix, entries[mine], (np.cumsum(large) - 1)[number[mine]], int(large.sum()))
                held = more if held is None else _Combiner._together([held, more])
                if held[1].size > HELD_CELLS:
                    yield vector_batch(held, names)
                    held = None
            end = np.cumsum(size)
            blobs = [None if big else entries[b - n : b].tobytes() for big, b, n in zip(large, end, size, strict=True)]
            few = keys.filter(pa.array(~large))
            if few.num_rows:
                blobs = pa.array([x for x in blobs if x is not None], pa.binary())
                yield pa.RecordBatch.from_arrays([few.column(0).combine_chunks(), blobs, pa.nulls(few.num_rows, pa.binary())], names)
        if held is not None:
            yield vector_batch(held, names)

    def vector_batch(held: tuple[pa.Table, np.ndarray], names: list[str]) -> pa.RecordBatch:
        rows = pa.array([v.tobytes() for v in held[1]], pa.binary())
        return pa.RecordBatch.from_arrays([held[0].column(0).combine_chunks(), pa.nulls(len(rows), pa.binary()), rows], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: every key leaves when the next one begins."""
        _, matrix = sent.value
        held: tuple[pa.Table, np.ndarray] | None = None
        for batch in batches:
            step = max(1, B.CELLS_PER_CHUNK // max(matrix.shape[1], 1))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                table = pa.Table.from_batches([part]).select([key])
                blobs = part.column("entries").to_pylist()
                entries = np.frombuffer(b"".join(x for x in blobs if x is not None), _ENTRY)
                owner = np.repeat(np.arange(len(blobs)), [len(x or b"") // _ENTRY.itemsize for x in blobs])
                sums = vectors(matrix, entries, owner, len(blobs))
                for k, x in enumerate(part.column("vector").to_pylist()):
                    if x is not None:
                        sums[k] += np.frombuffer(x, matrix.dtype)
                keys, sums = _added(table, sums)
                if held is not None:
                    keys, sums = pa.concat_tables([held[0], keys]), np.concatenate([held[1], sums])
                    if keys.num_rows > 1 and keys.column(0)[0].as_py() == keys.column(0)[1].as_py():
                        sums[1] += sums[0]
                        keys, sums = keys.slice(1), sums[1:]
                held = keys.slice(keys.num_rows - 1), sums[-1:]
                if keys.num_rows > 1:
                    yield done(keys.slice(0, keys.num_rows - 1), sums[:-1])
        if held is not None:
            yield done(*held)

    def done(keys: pa.Table, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.column(0).combine_chunks(), finish(sums)], [key, out])

    partial = counts.mapInArrow(count, f"`{key}` {key_type}, entries binary, vector binary")
    wanted = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.sparkSession.sparkContext.defaultParallelism, parts)
    dealt = partial.repartition(wanted, key).sortWithinPartitions(key)
    if then is None:
        return dealt.mapInArrow(total, f"`{key}` {key_type}, `{out}` {kind}")
    job, schema = then
    return dealt.mapInArrow(lambda batches: job(total(batches)), schema)


def rows_of(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of sorted index values; raises for a value that is missing."""
    at = np.searchsorted(known, wanted)
    if len(wanted) and (at.max() >= len(known) or not np.array_equal(known[at], wanted)):
        raise ValueError("a feature index is not in the codebook")
    return at
