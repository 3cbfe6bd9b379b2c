"""Exact removal of repeated byte strings by two-stage suffix sorting.

Every string of ``SPAN`` bytes that also starts earlier in the collection is found, whatever its place. To spread the sorting,
each such string (a window) is named by its anchor: the smallest hash among its ``GRAM``-byte substrings, so equal windows have
equal anchors. Neighbouring windows with one anchor form a segment, about one for 35 bytes of text.

1. Segments are dealt out by anchor as fixed-size numbers. Equal segments are collapsed before and after the exchange: all but
   the first are removed whole, and an anchor met once, or with one distinct segment, needs no text.
2. Only first occurrences of segments whose anchor has several distinct segments send their bytes. The task that receives them
   sorts their suffixes in two stages (``two_stage_sort``) and compares neighbours; windows that share ``SPAN`` bytes with an
   earlier one are removed.
3. An anchor with very many distinct segments (a common line in ever different surroundings) is not brought into one task: its
   windows are dealt out singly, by their own hash, and compared there.

Removed ranges meet their document again by doc_id. Hashes are 64 bits; two different segments are taken for equal only if the
hashes of both their anchor and their content agree.

Defined results: null and empty texts have no bytes; texts shorter than ``SPAN`` lose nothing. doc_id names a document: rows
repeated whole are answered alike and do not make each other repeats, and different texts under one id share their removed
ranges. Rows without an id count as the smallest id. Bounded memory: long documents are cut into overlapping blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import BYTE_VALUE, U64, bitmap, blocks, might_hold, mix, parts_of, prefix_sums, range_hash, record, string_buffer

SPAN = 100  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
REACH = SPAN - GRAM + 1  # anchors that a window chooses from
HOT_SEGMENTS = 1024  # distinct segments of an anchor above which its windows are dealt out singly
BLOCK = 1 << 20  # bytes whose windows are found at once; positions take 21 bits
BUFFER = 1 << 21  # segments that a task gathers before it sends them
SEND = 1 << 22  # bytes of requested text that a task gathers before it sends them
_LOW = U64((1 << 21) - 1)
NO_ID = -(1 << 63)


# --- two-stage suffix sorting -------------------------------------------------------------------------------------------------


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number, so that numbers compare as the bytes do."""
    out = np.zeros(len(at), U64)
    for k in range(8):
        out = (out << U64(8)) | data[at + k]
    return out


def ascending(data: np.ndarray) -> np.ndarray:
    """For every position but the last: whether its suffix is smaller than its successor's."""
    step = np.diff(data.astype(np.int16))
    n = len(step)
    # A run of equal bytes takes the sign of the first step after it.
    at = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step, -1)[nxt] > 0


def _direct_sort(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes: one pass of 8 bytes, and more only where ties are left."""
    order = np.argsort(_words_at(data, at), kind="stable")
    at = at[order]
    key = _words_at(data, at)
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    for done in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = _words_at(data, at[tied] + done)
        order = np.lexsort((key, group[tied]))
        at[tied], key, g = at[tied][order], key[order], group[tied]
        new = np.concatenate([[False], (key[1:] != key[:-1]) & (g[1:] == g[:-1])])
        # Groups are numbered anew; those that fell apart take more numbers.
        bump = np.zeros(len(at), np.int64)
        bump[tied] = new
        edge = np.concatenate([[0], group[1:] != group[:-1]]).astype(np.int64)
        group = np.cumsum(edge | bump)
    return at


def two_stage_sort(data: np.ndarray, wanted: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The ``wanted`` positions in the order of their suffixes' first ``depth`` bytes.

    Stage one sorts only suffixes that are smaller than their successors. Stage two scans the buckets of the first byte in
    order: a suffix that is larger than its successor is placed by its successor's rank, which an earlier scan has settled.
    ``data`` must go on for ``depth + 16`` bytes after the last wanted position.
    """
    if not len(wanted):
        return wanted
    up = ascending(data)
    # Successors are needed up to the next suffix that is sorted directly.
    need = np.zeros(len(data), bool)
    need[wanted] = True
    front = wanted
    while len(front):
        front = front[~up[front]] + 1
        front = front[front < len(up)]
        front = front[~need[front]]
        need[front] = True
    need[len(up) :] = False
    at = np.flatnonzero(need)
    direct = _direct_sort(data, at[up[at]], depth)
    rank = np.zeros(len(data) + 1, np.int64)
    first = data[direct]
    cuts = np.searchsorted(first, np.arange(257))
    rest = at[~up[at]]
    # How many bytes equal to its own follow a suffix: 'c x' with x < c comes before 'c c x'.
    same = data[:-1] == data[1:]
    stop = np.minimum.accumulate(np.where(~same, np.arange(len(same)), len(same))[::-1])[::-1]
    run = stop[rest] - rest
    order = np.lexsort((run, data[rest]))
    rest, run = rest[order], run[order]
    byte = data[rest].astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], (byte[1:] != byte[:-1]) | (run[1:] != run[:-1]), [True]])) if len(rest) else np.zeros(1, np.int64)
    out, filled, scanned = np.empty(len(at), np.int64), 0, 0

    def place(block: np.ndarray) -> None:
        nonlocal filled
        out[filled : filled + len(block)] = block
        rank[block] = np.arange(filled, filled + len(block)) + 1
        filled += len(block)

    for low, high in zip(edges[:-1], edges[1:], strict=True):
        while scanned < byte[low]:  # buckets of smaller bytes are complete: their directly sorted part comes last
            place(direct[cuts[scanned] : cuts[scanned + 1]])
            scanned += 1
        block = rest[low:high]
        place(block[np.argsort(rank[block + 1], kind="stable")])
    place(direct[cuts[scanned] :])
    mark = np.zeros(len(data), bool)
    mark[wanted] = True
    return out[mark[out]]


def same_prefix(data: np.ndarray, order: np.ndarray, length: int = SPAN) -> np.ndarray:
    """Whether each position but the first shares its first ``length`` bytes with the one before it."""
    equal = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        left = np.flatnonzero(equal)
        equal[left] = _words_at(data, order[left] + k) == _words_at(data, order[left + 1] + k)
    return equal


# --- segments ----------------------------------------------------------------------------------------------------------------


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, content hash) of the segments of a block of at most ``BLOCK`` bytes."""
    n = len(data)
    if n < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    sums = prefix_sums(BYTE_VALUE[data])
    at = np.arange(n - GRAM + 1)
    grams = range_hash(sums, at, at + GRAM)
    # Smallest hash first, then the last place: equal windows make the same choice.
    low = (grams & ~_LOW) | (_LOW - at.astype(U64))
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - SPAN + 1], low[REACH - width : REACH - width + n - SPAN + 1])
    anchor = (_LOW - (low & _LOW)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - SPAN + 1]
    valid = np.arange(n - SPAN + 1) + SPAN <= offsets[owner + 1]
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    return owner[first], first, count, grams[anchor[first]], range_hash(sums, first, first + count + SPAN - 1)


def _blocks_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, shift of each row) of blocks; a long document is cut into blocks that share SPAN - 1 bytes."""
    for a, b in blocks(offsets, BLOCK):
        low, high = offsets[a], offsets[b]
        if high - low <= BLOCK:
            yield data[low:high], offsets[a : b + 1] - low, np.arange(a, b), np.zeros(b - a, np.int64)
        else:
            for start in range(low, max(low + 1, high - SPAN + 1), BLOCK - SPAN + 1):
                end = min(high, start + BLOCK)
                yield data[start:end], np.array([0, end - start]), np.array([a]), np.array([start - low])


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose items are the bytes of ``values`` between the ``cuts``."""
    at = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(values))])


def _by(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct keys and the columns' items of each, packed."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cuts = np.append(first, len(key))
    return key[first], [packed(c[order], cuts) for c in columns]


_DOC, _SEGMENT, _REQUEST, _WINDOW = 0, 1, 2, 3
_ROW = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("anchor", pa.binary()), ("content", pa.binary()), ("doc", pa.binary()), ("first", pa.binary()), ("count", pa.binary())])
_ROW_SQL = "kind int, at long, anchor binary, content binary, doc binary, first binary, count binary"


def _rows(kind: int, key: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray | None = None, content: np.ndarray | None = None, doc: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each distinct key (a document, or a part of the exchange). Batches stay small."""
    given = [(anchor, U64), (content, U64), (doc, np.int64), (first, np.int32), (count, np.uint8)]
    keys, arrays = _by(key, *(np.asarray(x, t) for x, t in given if x is not None))
    if len(keys):
        filled = iter(arrays)
        batch = record(_ROW, np.full(len(keys), kind, np.int32), keys, *(pa.nulls(len(keys), pa.binary()) if x is None else next(filled) for x, _ in given))
        for k in range(0, len(keys), 10_000):
            yield batch.slice(k, 10_000)


def _removed(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _rows(_DOC, doc, first, count)


def _columns(batch: pa.RecordBatch, rows: np.ndarray) -> list[np.ndarray]:
    part = batch.filter(pa.array(rows))
    kinds = (U64, U64, np.int64, np.int32, np.uint8)
    return [np.frombuffer(string_buffer(part.column(k + 2))[0].tobytes(), t) for k, t in enumerate(kinds)]


def _collapse(anchor, content, doc, first, count):
    """Order by (anchor, content, document, place); which are firsts of their content, and which are strictly later repeats."""
    order = np.lexsort((first, doc, content, anchor))
    anchor, content, doc, first, count = (x[order] for x in (anchor, content, doc, first, count))
    if not len(anchor):
        return anchor, content, doc, first, count, np.zeros(0, bool), np.zeros(0, bool)
    lead = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
    of = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    later = (doc != doc[of]) | (first != first[of])
    return anchor, content, doc, first, count, lead, later


# --- the operator ------------------------------------------------------------------------------------------------------------


def _find_segments(parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, first, count, anchor, content = (np.concatenate(x) for x in zip(*held, strict=True))
            anchor, content, doc, first, count, lead, later = _collapse(anchor, content, doc, first, count)
            # A repeat inside the task is a repeat in the collection; only one row of each content travels.
            yield from _removed(doc[later], first[later], count[later])
            part = (anchor[lead] % U64(parts)).astype(np.int64)
            yield from _rows(_SEGMENT, part, first[lead], count[lead], anchor[lead], content[lead], doc[lead])

        for batch in batches:
            data, offsets = string_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for block, cuts, rows, shift in _blocks_of(data, offsets):
                owner, first, count, anchor, content = segments(block, cuts)
                held.append((ids[rows[owner]], first - cuts[owner] + shift[owner], count, anchor, content))
                size += len(owner)
                if size >= BUFFER:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return task


def _match_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part of the exchange: removed windows, and requests for the bytes of segments that must be compared."""
    held = [_columns(b, np.ones(b.num_rows, bool)) for b in batches]
    if not held:
        return
    anchor, content, doc, first, count, lead, later = _collapse(*(np.concatenate(x) for x in zip(*held, strict=True)))
    held.clear()
    yield from _removed(doc[later], first[later], count[later])
    anchor, content, doc, first, count = (x[lead] for x in (anchor, content, doc, first, count))
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(anchor)))[np.cumsum(new) - 1] if len(anchor) else np.zeros(0, int)
    ask = size > 1
    for kind, rows in ((_REQUEST, ask & (size <= HOT_SEGMENTS)), (_WINDOW, ask & (size > HOT_SEGMENTS))):
        yield from _rows(kind, doc[rows], first[rows], count[rows], anchor[rows])


_TEXT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("bytes", pa.binary())])
_TEXT_SQL = "part int, kind int, doc binary, first binary, count binary, bytes binary"


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def _send_text(parts: int, held_bytes: int = SEND):
    """Requested bytes, dealt out by anchor (single windows by their hash). What a task gathers leaves as one row for each part,
    whatever number of documents it comes from, so rows do not multiply with documents and parts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {_REQUEST: [], _WINDOW: []}
        size = 0
        for batch in batches:
            data, offsets = string_buffer(batch.column("text"))
            for row, (doc, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                own = data[offsets[row] : offsets[row + 1]]
                for kind in held:
                    some = [r for r in asked if r["kind"] == kind]
                    if not some:
                        continue
                    anchor = np.frombuffer(b"".join(r["anchor"] for r in some), U64)
                    first = np.frombuffer(b"".join(r["first"] for r in some), np.int32).astype(np.int64)
                    count = np.frombuffer(b"".join(r["count"] for r in some), np.uint8).astype(np.int64)
                    fits = first + count + SPAN - 1 <= len(own)  # of several texts under one id, only the one it came from
                    anchor, first, count = anchor[fits], first[fits], count[fits]
                    if kind == _REQUEST:
                        route, length = anchor, count + SPAN - 1
                        text = own[_ragged(first, length)]
                    else:
                        begin = _ragged(first, count)
                        route = range_hash(prefix_sums(BYTE_VALUE[own]), begin, begin + SPAN)
                        text = np.stack([np.repeat(anchor, count), route], 1).reshape(-1).view(np.uint8)
                        first, count = begin, np.ones(len(begin), np.int64)
                        length = np.full(len(begin), 16)
                    part = (mix(route) % U64(parts)).astype(np.int64)
                    held[kind].append((part, np.full(len(part), doc, np.int64), first.astype(np.int32), count.astype(np.uint8), length, text))
                    size += len(text)
                if size >= held_bytes:
                    yield from send(held)
                    held, size = {kind: [] for kind in held}, 0
        yield from send(held)

    def send(held: dict[int, list[tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
        for kind, pieces in held.items():
            if not pieces:
                continue
            part, doc, first, count, length, text = (np.concatenate(x) for x in zip(*pieces, strict=True))
            if not len(part):
                continue
            begin = np.cumsum(length) - length
            order = np.argsort(part, kind="stable")
            part, doc, first, count, length = (x[order] for x in (part, doc, first, count, length))
            lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            cuts = np.append(lead, len(part))
            text = packed(text[_ragged(begin[order], length)], np.concatenate([[0], np.cumsum(length)])[cuts])
            yield record(_TEXT, part[lead], [kind] * len(lead), packed(doc, cuts), packed(first, cuts), packed(count, cuts), text)

    return task


def _compare_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part: sort the suffixes of its segments and remove windows that an earlier one equals; likewise single windows."""
    held: dict[int, list[list[np.ndarray]]] = {_REQUEST: [], _WINDOW: []}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in held:
            if (kinds == kind).any():
                part = batch.filter(pa.array(kinds == kind))
                held[kind].append([np.frombuffer(string_buffer(part.column(c))[0].tobytes(), t) for c, t in (("doc", np.int64), ("first", np.int32), ("count", np.uint8), ("bytes", np.uint8))])
    if held[_REQUEST]:
        doc, first, count, text = (np.concatenate(x) for x in zip(*held.pop(_REQUEST), strict=True))
        size = count.astype(np.int64) + SPAN - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((first, doc))
        doc, first, count, size = doc[order], first[order].astype(np.int64), count[order].astype(np.int64), size[order]
        data = np.concatenate([text[_ragged(begin[order], size)], np.zeros(SPAN + 32, np.uint8)])
        begin = np.cumsum(size) - size
        wanted = _ragged(begin, count)
        owner = np.repeat(np.arange(len(doc)), count)
        where = np.repeat(first, count) + wanted - np.repeat(begin, count)
        number = np.zeros(len(data), np.int64)
        number[wanted] = np.arange(len(wanted))
        windows = number[two_stage_sort(data, wanted)]
        lead = np.concatenate([[True], ~same_prefix(data, wanted[windows])])
        yield from _later(windows, lead, doc[owner], where)
    if held[_WINDOW]:
        doc, first, _, text = (np.concatenate(x) for x in zip(*held.pop(_WINDOW), strict=True))
        pair = np.frombuffer(text.tobytes(), U64).reshape(-1, 2)
        place = np.lexsort((first, doc))
        order = place[np.lexsort((pair[place, 1], pair[place, 0]))]
        lead = np.concatenate([[True], (pair[order[1:]] != pair[order[:-1]]).any(1)])
        yield from _later(order, lead, doc, first.astype(np.int64))


def _later(order: np.ndarray, lead: np.ndarray, doc: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removed windows of groups of equal ones (``lead`` marks where a group begins): all after its first place."""
    begin = np.flatnonzero(lead)
    group = np.cumsum(lead) - 1
    doc, where = doc[order], where[order]
    low = np.minimum.reduceat(doc, begin)[group]
    at = np.minimum.reduceat(np.where(doc == low, where, np.iinfo(np.int64).max), begin)[group]
    gone = (doc != low) | (where != at)
    doc, where = doc[gone], where[gone]
    # Neighbouring windows become ranges again.
    by = np.lexsort((where, doc))
    doc, where = doc[by], where[by]
    if len(doc):
        cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (where[1:] - where[:-1] > 1)])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(doc)) - 1
        length = where[last] - where[first] + 1
        pieces = -(-length // 200)  # lengths are sent as bytes
        a = np.repeat(where[first], pieces) + 200 * _ragged(np.zeros(len(first), np.int64), pieces)
        end = np.repeat(where[last] + 1, pieces)
        yield from _removed(np.repeat(doc[first], pieces), a, np.minimum(200, end - a))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, first, count): packed starts and lengths of the runs of windows to remove, several rows a document."""
    parts = parts_of(docs)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").filter(F.octet_length("text") >= SPAN)
    found = cut_lineage(texts.mapInArrow(_find_segments(parts), _ROW_SQL))
    dealt = found.filter(F.col("kind") == _SEGMENT).repartitionById(parts, F.col("at").cast("int"))
    matched = cut_lineage(dealt.mapInArrow(_match_segments, _ROW_SQL))
    asked = matched.filter(F.col("kind").isin(_REQUEST, _WINDOW))
    bits = bitmap(asked, F.xxhash64("at"))
    some = _filtered(texts, bits, True)
    # A document's requests are bounded by its own length.
    by_doc = asked.groupBy(F.col("at").alias("doc_id")).agg(F.collect_list(F.struct("kind", "anchor", "first", "count")).alias("asked"))
    sent = some.join(by_doc, "doc_id").mapInArrow(_send_text(parts), _TEXT_SQL)
    compared = sent.repartitionById(parts, F.col("part")).mapInArrow(_compare_text, _ROW_SQL)
    ranges = found.filter(F.col("kind") == _DOC).unionByName(matched.filter(F.col("kind") == _DOC)).unionByName(compared)
    return ranges.select(F.col("at").alias("doc_id"), "first", "count")


def _filtered(texts: DataFrame, bits: np.ndarray, inside: bool) -> DataFrame:
    """Rows whose doc_id may be in the filter, or cannot be."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(might_hold(sent.value, batch.column("_key").to_numpy()) == inside))

    return texts.withColumn("_key", F.xxhash64("doc_id")).mapInArrow(task, texts.withColumn("_key", F.lit(0).cast("long")).schema).drop("_key")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _apply_ranges(keep_bytes: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in _KEPT]
            ranges = zip(batch.column("firsts").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            for row, (first, count) in enumerate(ranges):
                own = data[offsets[row] : offsets[row + 1]]
                n, removed, spans = len(own), 0, 0
                if first:
                    a = np.frombuffer(b"".join(first), np.int32).astype(np.int64)
                    e = np.minimum(a + np.frombuffer(b"".join(count), np.uint8) + SPAN - 1, n)
                    a = np.minimum(a, n)
                    delta = np.bincount(a, minlength=n + 1) - np.bincount(e, minlength=n + 1)
                    gone = np.cumsum(delta)[:n] > 0
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                    own = own[~gone]
                raw = own.tobytes()
                for c, x in zip(out, (ids[row], n, removed, spans, hashlib.sha256(raw).hexdigest(), raw if keep_bytes else None), strict=True):
                    c.append(x)
            yield record(_KEPT, *out)

    return task


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes as ``kept`` of every row."""
    ranges = cut_lineage(repeated_ranges(docs))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    none = F.lit(None).cast("array<binary>")
    bits = bitmap(ranges, F.xxhash64("doc_id"))
    # Documents that lose nothing never travel.
    whole = _filtered(texts, bits, False).select("doc_id", "text", none.alias("firsts"), none.alias("counts"))
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "count")).alias("ranges")).select("doc_id", F.col("ranges.first").alias("firsts"), F.col("ranges.count").alias("counts"))
    cut = _filtered(texts, bits, True).join(by_doc, "doc_id", "left").select("doc_id", "text", "firsts", "counts")
    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = whole.mapInArrow(_apply_ranges(keep_bytes), sql).unionByName(cut.mapInArrow(_apply_ranges(keep_bytes), sql))
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return out if keep_bytes else out.drop("kept")
