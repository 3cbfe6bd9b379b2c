"""Byte-level helpers used inside tasks: blocks of rows, words, hashes, and exchange by hash range.

All of them work on the value buffer of an Arrow string column, so that no Python object is made for a word. Blocks are bounded
by bytes: a task never holds more derived numbers than a few times ``BLOCK_BYTES``, unless one document alone is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that are turned into numbers at once.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)

#: White space of the word rule: blank and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN))


class _Powers:
    """Powers of the step and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _STEP), ("down", _BACK)):
                p = np.full(n, base, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums s with which ``range_hash`` finds the hash of any range of ``values``."""
    _, down = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * down[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the ranges [start, end); it depends on their content alone."""
    up, _ = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(U64) * U64(_GOLDEN))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (low, high) of at most ``limit`` bytes, or of one row."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of blocks of batches that have a column ``text``."""
    for batch in batches:
        data, offsets = string_buffer(batch.column("text"))
        for low, high in blocks(offsets, limit):
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a block, and the n + 1 positions of its rows in that list."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a block, and the positions of its rows in that list.

    Powers are needed up to the block's length only; a single document above ``8 * BLOCK_BYTES`` is hashed piece by piece, cut at
    white space.
    """
    starts, ends, at = word_bounds(data, offsets)
    values = BYTE_VALUE[LOWER[data]]
    if len(data) <= 8 * BLOCK_BYTES:
        return range_hash(prefix_sums(values), starts, ends), at
    out = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + 8 * BLOCK_BYTES, "right")))
        a, b = starts[low], ends[high - 1]
        out[low:high] = range_hash(prefix_sums(values[a:b]), starts[low:high] - a, ends[low:high] - a)
        low = high
    return out, at


def row_numbers(at: np.ndarray) -> np.ndarray:
    """Row of every item, from the n + 1 positions of the rows."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def parts_of(df: DataFrame) -> int:
    """Number of hash ranges of an exchange: the session's number of shuffle partitions, to be set in proportion to the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def deal(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, bytes, bytes, ...) for every part that has items: the columns' items of that part, in order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cuts)):
        yield (int(p), *(c[cuts[p] : cuts[p + 1]].tobytes() for c in columns))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from arrays or lists, in the order of the schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def remainder(column: str, mod: int) -> Column:
    """crc32 of a number written as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def bitmap(df: DataFrame, key: Column, buckets: int = 256) -> np.ndarray:
    """A filter of ``buckets`` * 32768 bits with a bit set for every key: fixed size, built by a map-side combined aggregate.

    ``might_hold`` then tells which keys may occur (no false negatives). The driver sees ``buckets`` rows of 4 KiB at most.
    """
    at = F.pmod(key, F.lit(buckets * 32768)) + 1
    found = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((buckets, 4096), np.uint8)
    for bucket, bits in found.collect():  # at most ``buckets`` rows
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def might_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed 64-bit keys may be in the ``bitmap``."""
    at = np.mod(keys.astype(np.int64), np.int64(len(bits) * 8))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Rows of tables of numbers that tasks add up: the table's name, the first position, and the numbers as bytes.
ARRAY_ROWS = "key string, at int, data binary"
_ARRAY_SCHEMA = pa.schema([("key", pa.string()), ("at", pa.int32()), ("data", pa.binary())])


def array_rows(key: str, numbers: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """A flat table cut into ranges of ``step`` numbers; ranges of zeros are left out, but never the last."""
    at = [a for a in range(0, len(numbers), step) if numbers[a : a + step].any() or a + step >= len(numbers)]
    yield record(_ARRAY_SCHEMA, [key] * len(at), at, [numbers[a : a + step].tobytes() for a in at])


def sum_arrays(parts: DataFrame, kind: type) -> DataFrame:
    """Sums of the rows of ``ARRAY_ROWS`` by key and position; a task holds its ranges' sums only, whatever the number of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for key, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, kind)
                if (key, at) in total:
                    total[key, at] += x
                else:
                    total[key, at] = x.copy()
        for (key, at), x in total.items():
            yield record(_ARRAY_SCHEMA, [key], [at], [x.tobytes()])

    return parts.repartition(parts_of(parts), "key", "at").mapInArrow(task, ARRAY_ROWS)
