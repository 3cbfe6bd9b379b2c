"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters and digits; in scripts without blanks, every character is one); numbers, units and names turn into typed placeholders, so a question whose
figures or names were exchanged keeps its template. Windows of ``WINDOW`` template tokens of the documents are hash-joined with
those of the benchmark. Matches of one document and item that lie on one diagonal (the same distance between their places) form
an alignment. In an alignment the slots must be consistent: every value of the item must always meet the same value of the
document. Consistent alignments count the item's windows that they cover; a document leaks an item when it covers at least
``COVERAGE`` of them, or when it has ``RUN`` tokens of the item in a row word for word, whatever their share and whatever else the
alignment changes. Two templates are kept of every text: one with names typed, one with plain lower-cased words, so that
changed capitals do not hide a copy. A window with fewer than ``LITERAL`` tokens besides its placeholders matches word for word only:
rows of figures would otherwise match each other without bound.

A fixed-size filter of the benchmark's hashes thins out the documents' windows inside the tasks before the join, whatever the
size of the benchmark; the few windows left are joined in Spark, by broadcast only if the benchmark's windows are few.

Defined results: null and empty texts match nothing; an item with fewer tokens than a window is one window of all of them, for
which documents have windows of its length too (one of placeholders only must then match word for word). An item without tokens is
not looked for. Items with equal text are all reported. Repeated rows of documents are judged alike.
Rows without doc_id or item_id are neither judged nor looked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import BLOCK_BYTES, BYTE_VALUE, LOWER, U64, bitmap, blocks, might_hold, mix, prefix_sums, range_hash, record, string_buffer

WINDOW = 5
COVERAGE = 0.5
RUN = 14  # tokens in a row
LITERAL = 2  # tokens of a window that are no placeholders, for it to match by its template
# Windows of the benchmark that are broadcast at most (24 bytes each); above, the join is a shuffle.
BROADCAST_WINDOWS = 1 << 20
#: Units of measure and money, typed as placeholders when they follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mile", "miles", "mg", "g", "kg", "t", "oz", "lb", "lbs", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "gram", "grams", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "kmh", "mph", "hz", "kb", "mb", "gb", "tb", "w", "kw", "v", "j", "n", "pa")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3A, 0x3B, 0x3F]] = True  # a capital after these begins a sentence and is no name
_NUMBER, _NAME, _UNIT = (U64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))


#: Scripts written without blanks: Thai to Lao, Myanmar, Khmer, kana, bopomofo, Han, half-width kana.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 between tokens, 1 within one, 2 a token of its own."""
    between = [c for c in range(0x20000) if unicodedata.category(chr(c))[0] in "PSZ" or unicodedata.category(chr(c)) == "Cc"]
    out = np.ones(0x110000, np.int8)
    for low, high in _UNSPACED:
        out[low : high + 1] = 2
    out[[*between, 0x200B, 0xFEFF]] = 0
    return out


def _wide(data: np.ndarray, solid: np.ndarray, edge: np.ndarray) -> None:
    """Characters outside ASCII: those between tokens are not solid, those that are tokens have an edge on both sides."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return
    first = data[lead].astype(np.int64)
    n1, n2, n3 = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
    point = np.where(first < 0xE0, (first & 31) << 6 | n1, np.where(first < 0xF0, (first & 15) << 12 | n1 << 6 | n2, (first & 7) << 18 | n1 << 12 | n2 << 6 | n3))
    kind = _kinds()[np.minimum(point, 0x10FFFF)]
    end = np.minimum(lead + 2 + (first >= 0xE0) + (first >= 0xF0), len(data))
    for k in range(4):
        some = (kind == 0) & (lead + k < end)
        solid[lead[some] + k] = False
    edge[lead[kind == 2]] = True
    edge[end[kind == 2]] = True


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return range_hash(prefix_sums(BYTE_VALUE[data]), np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], U64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: lower-cased token hashes, the same with placeholders for numbers and units, with names typed too, and the
    n + 1 positions of its rows."""
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    _wide(data, solid, edge)
    # A point or comma between digits belongs to the number.
    if len(data) > 2:
        digit = (data >= 48) & (data <= 57)
        solid[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(start, offsets)
    words = range_hash(prefix_sums(BYTE_VALUE[LOWER[data]]), start, end)
    number = (data[start] >= 48) & (data[start] <= 57)
    plain = words.copy()
    plain[number] = _NUMBER
    after = np.concatenate([[False], number[:-1]])
    after[at[:-1][at[:-1] < len(start)]] = False  # the number before belongs to another row
    plain[after & ~number & np.isin(words, _UNIT_HASHES)] = _UNIT
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(start), bool)  # first of its row, or after the end of a sentence
    opens[1:] = stops[start[1:]] > stops[end[:-1]]
    opens[at[:-1][at[:-1] < len(start)]] = True
    capital = (data[start] >= 65) & (data[start] <= 90)
    typed = plain.copy()
    typed[capital & ~opens & ~number] = _NAME
    return words, plain, typed, at


def window_hashes(items: np.ndarray, at: np.ndarray, window: int = WINDOW, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window, in order; if ``short``, a row with fewer tokens has one window of all, if it has any."""
    size = np.diff(at)
    count = np.where(size >= window, size - window + 1, np.minimum(size, 1) if short else 0)
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = at[row] + place
    end = np.minimum(start + window, at[row + 1])
    return row, range_hash(prefix_sums(mix(items)), start, end)


_WINDOW_SCHEMA = pa.schema([("id", pa.int64()), ("form", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()), ("slots", pa.binary())])
_WINDOW_SQL = "id long, form int, hash long, place long, slots binary"


def _windows(window: int, bits: np.ndarray | None, lengths: tuple[int, ...] = ()):
    """Windows of items (without ``bits``), or those of documents, of ``window`` and of the shorter ``lengths``, that the filter holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffer(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for low, high in blocks(offsets, BLOCK_BYTES):
                words, plain, typed, at = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                shown = words.view(np.int64)
                for form, stream, size in ((f, x, n) for f, x in enumerate((plain, typed)) for n in (window, *lengths)):
                    row, hashes = window_hashes(stream, at, size, bits is None)
                    count = np.bincount(row, minlength=len(at) - 1)
                    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                    start = at[row] + place
                    stop = np.minimum(start + size, at[row + 1])
                    # A window with hardly any literal token says too little: it stands for its very words.
                    literal = np.concatenate([[0], np.cumsum(~np.isin(stream, (_NUMBER, _NAME, _UNIT)))])
                    bare = literal[stop] - literal[start] < LITERAL
                    if bare.any():
                        hashes = np.where(bare, window_hashes(words, at, size, bits is None)[1], hashes)
                    keys = hashes.view(np.int64)
                    hit = np.arange(len(row)) if bits is None else np.flatnonzero(might_hold(bits, keys))
                    if not len(hit):
                        continue
                    # The values in the window, to compare slot by slot.
                    slots = [shown[a:b].tobytes() for a, b in zip(start[hit], stop[hit], strict=True)]
                    yield record(_WINDOW_SCHEMA, ids[low + row[hit]], np.full(len(hit), form, np.int32), keys[hit], place[hit], slots)

    return task


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, form, hash, place, slots and n_windows (of the item, in one form) of every item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    rows = items.mapInArrow(_windows(window, None), _WINDOW_SQL)
    counted = rows.groupBy("id").agg(F.max("place").alias("last"))
    return rows.join(counted, "id").select(F.col("id").alias("item_id"), "form", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), (F.col("last") + 1).alias("n_windows"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """doc_id, item_id, covered, n_windows, exact of every pair whose consistent alignments cover enough of the item, or that has a
    verbatim run of enough tokens."""
    known = cut_lineage(benchmark_windows(benchmark, window))
    bits = bitmap(known, F.col("hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    size = (F.octet_length("item_slots") / 8).cast("int").alias("size")
    lengths = tuple(r.size for r in known.select(size).distinct().filter(F.col("size") < window).collect())  # of short items
    found = texts.mapInArrow(_windows(window, bits, lengths), _WINDOW_SQL).withColumnRenamed("id", "doc_id")
    few = known.count() <= BROADCAST_WINDOWS
    matched = found.join(F.broadcast(known) if few else known, ["hash", "form"])
    # Slot values lie at item_place + k of the item and place + k of the document.
    width = F.least(F.octet_length("slots"), F.octet_length("item_slots")) / 8
    same = F.col("slots") == F.col("item_slots")
    diagonal = (F.col("place") - F.col("item_place")).alias("diagonal")
    pairs = F.transform(F.sequence(F.lit(1), width.cast("int")), lambda k: F.struct(F.substring("item_slots", (k - 1) * 8 + 1, F.lit(8)).alias("was"), F.substring("slots", (k - 1) * 8 + 1, F.lit(8)).alias("now")))
    changed = F.filter(pairs, lambda p: p["was"] != p["now"])
    rows = matched.select("doc_id", "item_id", "form", diagonal, "item_place", "n_windows", same.alias("same"), F.when(~same, pairs).alias("pairs"), F.when(~same, changed).alias("changed"))
    # An alignment holds each place of the item once, so what is collected for it is bounded by the item.
    aligned = rows.groupBy("doc_id", "item_id", "form", "diagonal", "n_windows").agg(
        F.sort_array(F.collect_set("item_place")).alias("places"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        F.min("same").alias("exact"),
        F.sort_array(F.collect_set(F.when(F.col("same"), F.col("item_place")))).alias("verbatim"),
    )
    # Places in a row keep their distance to their position in the list: the longest stretch of one distance is the longest run.
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    step = lambda a, x: F.when(a["at"] == x, a["n"] + 1).otherwise(F.lit(1))
    longest = F.aggregate(F.transform("verbatim", lambda p, k: p - k), start, lambda a, x: F.struct(x.alias("at"), step(a, x).alias("n"), F.greatest(a["most"], step(a, x)).alias("most")), lambda a: a["most"])
    aligned = aligned.withColumn("long", longest + window - 1 >= run)
    # Consistent: as many different pairs as different values of the item.
    one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["was"])))
    # Of an inconsistent alignment with a long verbatim run, the verbatim places count.
    places = F.when(one, F.col("places")).otherwise(F.col("verbatim"))
    covered = aligned.filter(one | F.col("long")).select("doc_id", "item_id", "form", "n_windows", "exact", "long", F.explode(places).alias("place"))
    per_form = covered.groupBy("doc_id", "item_id", "form", "n_windows").agg(F.countDistinct("place").alias("covered"), F.min("exact").alias("exact"), F.max("long").alias("long"))
    best = per_form.groupBy("doc_id", "item_id", "n_windows").agg(F.max("covered").alias("covered"), F.max("exact").alias("exact"), F.max("long").alias("long"))
    return best.filter((F.col("covered") >= F.col("n_windows") * coverage) | F.col("long")).select("doc_id", "item_id", "covered", "n_windows", "exact")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items (leaked), best coverage and the smallest item_id of the best, for every document row."""
    leaks = find_leaks(docs, benchmark)
    share = (F.col("covered") / F.col("n_windows")).alias("share")
    best = leaks.select("doc_id", "item_id", share).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("share").alias("coverage"), F.max_by("item_id", F.struct("share", -F.col("item_id"))).alias("item_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id", F.col("n_items").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of documents that leak no item; all columns stay, and rows without doc_id stay."""
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long") == leaked["_leaked"], "left_anti")
