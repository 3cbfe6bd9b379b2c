"""Packing whole documents into sequences of a fixed number of tokens, as few as large-item matching and best fit give.

A document becomes its token ids and one end id; only a document longer than a sequence is cut, into full pieces with the shorter
one in front. How pieces are combined depends on their lengths alone, and there are at most ``capacity`` lengths: the counts of
the lengths are all that the plan needs, whatever the number of documents. Pieces above a third of the capacity fit at most twice
into a sequence; from the longest on, each takes the longest other one that still fits, which is a largest matching. Then smaller
pieces, from the longest on, go where they leave the least room, and into new sequences where they fit nowhere. Equal
sequences are planned together as one pattern and a count, so the plan has a few thousand rows at most.

Every piece then finds its place by its length and its rank among the pieces of that length. A task numbers its own pieces of each
length as it cuts them, the numbers of earlier tasks are added by one window over (task, length) counts, and no piece is sorted.

Defined results: null text counts as empty and is one piece with the end id alone; the end id counts as a token and is cut
like any other. Rows with one doc_id, or with none, are packed as separate documents. Other columns are ignored. No documents, no rows.
The vocabulary file must lie at the same path on every executor. Ids are those of ``tokenizers``; they are computed with the
faster ``tiktoken`` from the same vocabulary (a test compares both over all characters).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from .rollups import SPLIT_PATTERN, pieces
from .text import record

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
END = 2

#: (number of sequences, ((length, times), ...) in the order of their places).
Pattern = tuple[int, tuple[tuple[int, int], ...]]


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizer file. Its characters stand for bytes: printable ones for themselves, the others,
    in order, for the characters from 256 on."""
    tokenizer = Tokenizer.from_file(path)
    special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in tokenizer.get_vocab().items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str = VOCABULARY, end: int = END) -> np.ndarray:
    """Ids of a text, a bounded number of characters at a time, and the end id."""
    encoding = _encoding(path)
    parts = [encoding.encode_to_numpy(p, allowed_special="all") for p in pieces(text or "")]
    return np.concatenate([*parts, [end]]).astype(np.uint32)


def cuts(n: int, capacity: int) -> np.ndarray:
    """Ends of the pieces of a document of n tokens, from 0 on: all but the first are full."""
    return np.append(0, np.arange((n - 1) % capacity + 1, n + 1, capacity))


def plan_sequences(counts: Sequence[int], capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[n]`` pieces of every length n."""
    left = [int(c) for c in counts] + [0] * (capacity + 1 - len(counts))
    room: list[list[tuple[int, tuple[tuple[int, int], ...]]]] = [[] for _ in range(capacity + 1)]
    large = capacity // 3 + 1
    for a in range(capacity, large - 1, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b >= large and left[b] < (2 if b == a else 1):
                b -= 1
            if b < large:
                room[capacity - a].append((left[a], ((a, 1),)))
                left[a] = 0
            elif a == b:
                room[capacity - 2 * a].append((left[a] // 2, ((a, 2),)))
                left[a] %= 2
            else:
                n = min(left[a], left[b])
                room[capacity - a - b].append((n, ((a, 1), (b, 1))))
                left[a] -= n
                left[b] -= n
    for size in range(min(large - 1, capacity), 0, -1):
        for gap in range(size, capacity + 1):
            if not left[size]:
                break
            groups, room[gap] = room[gap], []
            each = gap // size
            for n, held in groups:
                full = min(n, left[size] // each)
                rest = left[size] - full * each if full < n else 0
                left[size] -= full * each + rest
                if full:
                    room[gap - each * size].append((full, (*held, (size, each))))
                if rest:
                    room[gap - rest * size].append((1, (*held, (size, rest))))
                if n - full - bool(rest):
                    room[gap].append((n - full - bool(rest), held))
        each = capacity // size
        if left[size] // each:
            room[capacity - each * size].append((left[size] // each, ((size, each),)))
        if left[size] % each:
            room[capacity - left[size] % each * size].append((1, ((size, left[size] % each),)))
    return [pattern for gap in room for pattern in gap]


def places(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of places for pieces of one length, sorted by (length, rank of the first piece): first sequence, pieces in a sequence
    and place of the first in it."""
    rows, sequence, rank = [], 0, {}
    for n, held in plan:
        offset = 0
        for size, times in held:
            first = rank.get(size, 0)
            rows.append((size, first, sequence, times, offset))
            rank[size] = first + n * times
            offset += size * times
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T, strict=True))


def cut_documents(docs: DataFrame, capacity: int, path: str, end: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, rank of the piece among the task's pieces of that length[, ids]."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    sql = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
    schema = pa.schema(list(zip(names, kinds, strict=True)) + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (capacity + 1)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for key, text in zip(keys, batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), path, end)
                edge = cuts(len(ids), capacity).tolist()
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    part = ids[a:b]
                    rows.append((key, k, a, b - a, zlib.crc32(part.astype("<u4").tobytes()), seen[b - a], *([part] if with_ids else [])))
                    seen[b - a] += 1
                if len(rows) > 10_000:
                    yield record(schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield record(schema, *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, sql + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids where wanted."""
    cut = cut_lineage(cut_documents(docs, capacity, path, end, with_ids).withColumn("task", F.spark_partition_id()))
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = cut_lineage(counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    totals = np.zeros(capacity + 1, np.int64)
    for row in first.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        totals[row["length"]] = row["n"]
    sent = docs.sparkSession.sparkContext.broadcast(places(plan_sequences(totals, capacity)))  # bounded by the capacity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        run_key = (at["length"] << 48) | at["rank"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(run_key, (size << 48) | rank, "right") - 1
            turn, place = np.divmod(rank - at["rank"][run], at["times"][run]) if len(run) else (rank, rank)
            sequence, offset = at["sequence"][run] + turn, at["offset"][run] + place * size
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    more = ["ids"] if with_ids else []
    ranked = cut.join(first.select("task", "length", "first"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *more, "rank").mapInArrow(task, f"{sql}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the starts of its pieces, from pieces packed with their ids; a sequence is bounded by the capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(held.alias("held"))
    return grouped.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.offset").alias("offsets"), F.col("held.doc_id").alias("doc_ids"))
