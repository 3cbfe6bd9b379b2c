"""Exact Jaccard join of word n-gram sets with signature trees.

Two documents link when the Jaccard similarity of their sets of distinct ``SHINGLE``-word shingles is at least ``PERCENT`` percent.
The result is one row per document with the component of the link graph it belongs to.

1. *Classes.* Equal sets form a class; only its digest, size and smallest doc_id travel on.
2. *Thinning.* A linked document shares most of its shingles with another. Every document offers the half of its shingles with
   the smallest hashes; two linked documents have at least a fixed number of those in common (prefix lemma), so documents with
   fewer offered shingles that occur in a second set cannot link. Occurrences are counted by hash range; a task that has seen a
   shingle in two sets says so once, so a common shingle costs a row a task. What is left is a superset of the linked documents.
3. *Blocks.* The sets of those are tied by their prefixes (a quarter of the shingles, rare ones first); linked documents share a
   prefix shingle, so each component of this coarser graph is a block. In many texts, shingles that are not rare tie texts of
   all sizes into one block, so blocks above ``CHUNK`` sets are tied anew for sets of one size level and the next only, and by the
   shorter prefix that the smaller of two linked sets shares. Those that are still larger are cut into chunks.
4. *Signature trees.* In a chunk the sets are ordered by size and smallest hashes and become leaves of a tree whose nodes hold
   the OR of their bitmaps and the range of their sizes. A dual traversal from (root, root) drops pairs of nodes whose largest
   possible overlap is too small, whose sizes are too different, or whose members are all linked already. Leaf pairs left are
   compared exactly. Links are kept as a spanning forest: copies need not be expanded into all pairs.
5. *Rest.* Chunks of one block are compared with each other by the same traversal, unless all members of both are linked already.

``jaccard_components`` stops there. ``jaccard_links`` also counts every document's links: its traversal drops pairs of nodes by size
and overlap only, and the leaf pairs left are compared whole, with one 64-bit mask of the left leaf's sets for every shingle. Links
between classes are weighed by the classes' members, so copies are counted without being expanded. No pair is written: a task sends
one number a set. Counting all links costs the square of the different texts of a group, in pieces of two chunks a task.

Sets travel as 64-bit hashes of shingles; sets are compared by them.

Defined results: null texts, and texts without words, have an empty set and link with nothing. A text with fewer words than a
shingle has its whole sequence as its one shingle. Rows without doc_id get component null and no links. Repeated rows are answered
alike; each counts as a document, so it links with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_KEYS, cut_lineage
from .text import ARRAY_ROWS, U64, array_rows, bitmap, deal, might_hold, mix, parts_of, prefix_sums, range_hash, record, string_buffer, sum_arrays, text_blocks, word_hashes

SHINGLE = 5
PERCENT = 75
CHUNK = 4096  # sets of a block that one task compares with each other, at most
CHUNK_ITEMS = 1 << 22  # shingles of those sets, at most
LEAF = 8
LINK_CHUNK = 1024  # as CHUNK, where all links are counted
LEVEL = float(np.log(100 / PERCENT))  # linked sets differ in the logarithm of their size by this much at most
OFFERED = 1 << 21  # offered shingles that a task gathers before it sends them
SKETCH = 1 << 18  # counters of the rarity order
FILTER_BUCKETS = 1 << 13  # most buckets (4 KiB each) of the filter of candidates; beyond, candidates are found by a join


# --- sets --------------------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, n + 1 positions of the rows) of a block of texts."""
    words, at = word_hashes(data, offsets)
    size = np.diff(at)
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hashes = range_hash(prefix_sums(words), start, np.minimum(start + width, at[row + 1]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.searchsorted(row, np.arange(len(size) + 1))


def set_digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    n = len(at) - 1
    out = np.zeros((2, n), U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[0, full] = np.add.reduceat(mix(hashes), at[full])
        out[1, full] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), at[full])
    return out[0], out[1]


def need(size: np.ndarray) -> np.ndarray:
    """Fewest shingles that a set of this size shares with a set it links with."""
    return -(-size * PERCENT // 100)


def spare(size: np.ndarray) -> np.ndarray:
    """Offered shingles beyond the prefix: a quarter of the set; also what two linked sets have in common among the offered."""
    return -(-size // 4)


def offered(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, size - need(size) + spare(size))


def asked(size: np.ndarray) -> np.ndarray:
    """Shared shingles among the offered without which a set has no link: the least that any possible partner guarantees."""
    return np.where(size > 0, spare(need(size)), 1)


# --- classes and thinning ------------------------------------------------------------------------------------------------------

_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
_DOCS_SQL = "doc_id long, n long, d1 long, d2 long"
_SCAN = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])
_SCAN_SQL = "kind int, part int, keys binary, sets binary"
_OFFER, _CREDIT = 0, 1
_MANY = U64(0)  # in place of a set's digest: the shingle is known to occur in several sets


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the run of every item."""
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    return np.flatnonzero(lead), np.cumsum(lead) - 1


def _credits(sets: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """How many of each set's offered shingles were found in another set: one row for each part of the next exchange."""
    name, count = np.unique(sets, return_counts=True)
    for p, a, b in deal((mix(name) % U64(parts)).astype(np.int64), parts, count.astype(np.uint32), name):
        yield record(_SCAN, [_CREDIT], [p], [a], [b])


def _describe(width: int):
    """Size and digests of every row's set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            hashes, at = shingle_sets(data, offsets, width)
            d1, d2 = set_digests(hashes, at)
            yield record(_DOCS, rows.column("doc_id"), np.diff(at), d1.view(np.int64), d2.view(np.int64))

    return task


def _offer(parts: int, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, size = [], [], 0
        known: set[int] = set()  # sets of this task that are counted already; forgotten when it grows too large

        def flush() -> Iterator[pa.RecordBatch]:
            key, name = np.concatenate(keys), np.concatenate(names)
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            first, run = _runs(key)
            several = np.maximum.reduceat(name, first) != name[first]
            # Found in two sets here: they are credited here, and one row tells all others.
            yield from _credits(name[several[run]], parts)
            name = name[first].copy()
            name[several] = _MANY
            part = ((key[first] >> U64(32)) % U64(parts)).astype(np.int64)
            low = (key[first] & U64(0xFFFFFFFF)).astype(np.uint32)
            for p, a, b in deal(part, parts, low, name):
                yield record(_SCAN, [_OFFER], [p], [a], [b])

        for _, data, offsets in text_blocks(batches):
            hashes, at = shingle_sets(data, offsets, width)
            d1, _ = set_digests(hashes, at)
            n = np.diff(at)
            fresh = np.array([int(x) not in known and not known.add(int(x)) for x in d1], bool) & (n > 0)
            if len(known) > 1 << 20:
                known.clear()
            take = np.where(fresh, offered(n), 0)
            place = np.repeat(at[:-1] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
            keys.append(hashes[place])
            names.append(np.repeat(d1, take))
            size += len(place)
            if size >= OFFERED:
                yield from flush()
                keys, names, size = [], [], 0
        if size:
            yield from flush()

    return task


def _count_offers(parts: int):
    """Of one hash range: credit the sets whose shingles occur in a second one. Credits given earlier pass through."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names = [], []
        for batch in batches:
            offers = batch.column("kind").to_numpy() == _OFFER
            yield batch.filter(pa.array(~offers))
            some = batch.filter(pa.array(offers))
            keys.append(np.frombuffer(string_buffer(some.column("keys"))[0].tobytes(), np.uint32))
            names.append(np.frombuffer(string_buffer(some.column("sets"))[0].tobytes(), U64))
        if keys and sum(map(len, keys)):
            key, name = np.concatenate(keys), np.concatenate(names)
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            first, run = _runs(key)
            several = (np.maximum.reduceat(name, first) != name[first]) | (name[first] == _MANY)
            yield from _credits(name[several[run] & (name != _MANY)], parts)

    return task


_SUM = pa.schema([("d1", pa.int64()), ("credit", pa.int64())])


def _add_credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.frombuffer(string_buffer(b.column("keys"))[0].tobytes(), np.uint32), np.frombuffer(string_buffer(b.column("sets"))[0].tobytes(), U64)) for b in batches]
    if held:
        count, name = (np.concatenate(x) for x in zip(*held, strict=True))
        name, inverse = np.unique(name, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(name)).astype(np.int64)
        for k in range(0, len(name), 10_000):
            yield record(_SUM, name[k : k + 10_000].view(np.int64), total[k : k + 10_000])


def _thin(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, d1, d2) of every row; (rep, n, d1, d2, members) of the classes that may link with another.

    The text is read twice, so that the offered shingles travel once and are never stored."""
    parts = parts_of(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(texts.mapInArrow(_describe(width), _DOCS_SQL))
    offers = texts.select("text").mapInArrow(_offer(parts, width), _SCAN_SQL).repartitionById(parts, F.col("part"))
    given = offers.mapInArrow(_count_offers(parts), _SCAN_SQL).repartitionById(parts, F.col("part"))
    credit = given.mapInArrow(_add_credits, "d1 long, credit long")
    classes = rows.filter("doc_id is not null and n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    least = F.ceil(F.ceil(F.col("n") * PERCENT / 100) / 4)
    return rows, cut_lineage(classes.join(credit, "d1").filter(F.col("credit") >= least).select("rep", "n", "d1", "d2", "members"))


# --- sets of the candidates and blocks -------------------------------------------------------------------------------------------

_SETS = pa.schema([("rep", pa.int64()), ("d1", pa.int64()), ("items", pa.binary())])
_SETS_SQL = "rep long, d1 long, items binary"


def _candidate_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """rep, d1, items: the sorted hashes of the candidates' sets, and of a few others that the filter lets through; those and
    repeated rows do no harm, as later joins are by (rep, d1) and a set's links with itself are dropped."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("key")).filter("doc_id is not null and text is not null")
    # Sixteen bits a candidate.
    buckets = max(256, -(-16 * classes.count() // 32768))
    if buckets > FILTER_BUCKETS:
        texts = texts.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sent = None
    else:
        sent = docs.sparkSession.sparkContext.broadcast(bitmap(classes, F.xxhash64("rep"), buckets))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch if sent is None else batch.filter(pa.array(might_hold(sent.value, batch.column("key").to_numpy())))
            for rows, data, offsets in text_blocks(iter([some])):
                hashes, at = shingle_sets(data, offsets, width)
                raw = hashes.tobytes()
                items = [raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield record(_SETS, rows.column("doc_id"), set_digests(hashes, at)[0].view(np.int64), items)

    return texts.mapInArrow(task, _SETS_SQL)


def _iter_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = string_buffer(batch.column("items"))
        for low in range(0, batch.num_rows, 2000):
            high = min(batch.num_rows, low + 2000)
            part = data[offsets[low] : offsets[high]]
            yield batch.slice(low, high - low), np.frombuffer(part.tobytes(), U64), (offsets[low : high + 1] - offsets[low]) // 8


def _sketch(sets: DataFrame) -> np.ndarray:
    """Counters of hashed shingles over all candidates, added up in the executors: a fixed-size rarity order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for _, items, _ in _iter_sets(batches):
            total += np.bincount((items >> U64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
        if total.any():
            yield from array_rows("", total, SKETCH // 64)

    out = np.zeros(SKETCH, np.int64)
    for r in sum_arrays(sets.mapInArrow(task, ARRAY_ROWS), np.int64).collect():  # SKETCH numbers
        x = np.frombuffer(r["data"], np.int64)
        out[r["at"] : r["at"] + len(x)] = x
    return out


_TIE_SQL = "part int, keys binary, reps binary"
_TIE = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("reps", pa.binary())])
_EDGE_SQL = "a long, b long"
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _ties(parts: int, rarity: np.ndarray, spark):
    sent = spark.sparkContext.broadcast(rarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, items, at in _iter_sets(batches):
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            count = sent.value[(items >> U64(40)).astype(np.int64) % SKETCH]
            order = np.lexsort((items, count, row))
            inside = np.arange(len(items)) - np.repeat(at[:-1], n)
            keep = order[inside < np.repeat(n - need(n) + 1, n)]
            part = (mix(items[keep]) % U64(parts)).astype(np.int64)
            reps = rows.column("rep").to_numpy()[row[keep]]
            for p, a, b in deal(part, parts, items[keep], reps):
                yield record(_TIE, [p], [a], [b])

    return task


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        """Root of every member."""
        out = self.up
        while True:
            more = out[out]
            if (more == out).all():
                self.up = more
                return more
            out = more


def _merge_labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Component of 0..n-1 under edges, by repeated minima over whole arrays."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _tie_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: edges that tie all sets sharing a prefix shingle, as stars around the smallest of each component."""
    keys, reps = [], []
    for b in batches:
        keys.append(np.frombuffer(string_buffer(b.column("keys"))[0].tobytes(), U64))
        reps.append(np.frombuffer(string_buffer(b.column("reps"))[0].tobytes(), np.int64))
    if not keys:
        return
    key, rep = np.concatenate(keys), np.concatenate(reps)
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    names, number = np.unique(rep, return_inverse=True)
    first, run = _runs(key)
    label = _merge_labels(number[first][run], number, len(names))
    far = label != np.arange(len(names))
    yield record(_EDGE, names[label[far]], names[far])


EDGES_AT_ONCE = 1 << 21  # edges that one task may hold (16 bytes each)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (smallest node, node) of the components of one task's edges."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        names, number = np.unique(np.concatenate([left, right]), return_inverse=True)
        label = _merge_labels(number[: len(left)], number[len(left) :], len(names))
        far = np.flatnonzero(label != np.arange(len(names)))
        for k in range(0, len(far), 10_000):
            yield record(_EDGE, names[label[far[k : k + 10_000]]], names[far[k : k + 10_000]])


def components(edges: DataFrame) -> DataFrame:
    """node, label: smallest node of the component, for every node of (a, b) edges.

    While there are more edges than one task may hold, rounds shrink them: tasks replace their edges by stars, nodes follow
    their smallest neighbour twice, and edges between equal labels go. The rest is settled in one task.
    """
    parts = parts_of(edges)
    some = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut_lineage(some.repartition(parts, "b").mapInArrow(_contract, _EDGE_SQL).distinct())
    maps: list[DataFrame] = []
    while edges.count() > EDGES_AT_ONCE:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("to"))
        low = cut_lineage(low.join(low.select(F.col("node").alias("to"), F.col("to").alias("end")), "to").select("node", F.col("end").alias("to")))
        maps.append(low)
        moved = edges.join(low.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(low.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        moved = moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = cut_lineage(moved.repartition(parts, "b").mapInArrow(_contract, _EDGE_SQL).distinct())
    stars = edges.coalesce(1).mapInArrow(_contract, _EDGE_SQL)  # at most EDGES_AT_ONCE edges
    roots = stars.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("to"))
    whole = cut_lineage(stars.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(roots))
    # Nodes of a later round are labels of the one before, so the maps compose from the last to the first.
    for earlier in reversed(maps):
        later = whole.select(F.col("node").alias("to"), F.col("to").alias("end"))
        whole = cut_lineage(earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    return whole.select("node", F.col("to").alias("label"))


# --- signature trees -------------------------------------------------------------------------------------------------------------


class Tree:
    """Leaves of up to LEAF sets and their ancestors, with OR bitmaps, size ranges and the most collisions of a bitmap."""

    def __init__(self, sets: list[np.ndarray], width: int, leaf: int = LEAF) -> None:
        self.sets, self.leaf = sets, leaf
        self.size = np.array([len(s) for s in sets])
        self.bits = np.zeros((len(sets), width // 64), U64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        bit = (np.concatenate(sets) >> U64(7)) % U64(width)
        np.bitwise_or.at(self.bits, (owner, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
        self.extra = self.size - np.bitwise_count(self.bits).sum(1)
        # Levels from the leaves to the root; node k of a level covers nodes 2k and 2k + 1 below it.
        starts = np.arange(0, len(sets), leaf)
        level = [np.bitwise_or.reduceat(self.bits, starts, axis=0), np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts), np.maximum.reduceat(self.extra, starts)]
        self.levels = [level]
        while len(level[0]) > 1:
            pair = np.arange(0, len(level[0]), 2)
            level = [np.bitwise_or.reduceat(level[0], pair, axis=0), np.minimum.reduceat(level[1], pair), np.maximum.reduceat(level[2], pair), np.maximum.reduceat(level[3], pair)]
            self.levels.append(level)

    def members(self, level: int, node: int) -> range:
        step = self.leaf << level
        return range(node * step, min(len(self.sets), (node + 1) * step))

    def below(self, level: int, node: int) -> list[int]:
        return [k for k in (2 * node, 2 * node + 1) if k < len(self.levels[level - 1][0])]


def bitmap_width(most: int) -> int:
    """Bits of the signatures of a block: twice the largest set, as a power of two; at most 2**16."""
    return min(1 << 16, max(256, 1 << int(2 * most - 1).bit_length()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(a) + len(b)
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    shared = np.concatenate([a, b])
    shared.sort(kind="stable")
    same = int((shared[1:] == shared[:-1]).sum())
    return 100 * same >= PERCENT * (both - same)


def leaf_pairs(left: Tree, right: Tree, settled: Callable[[range, range], bool] | None = None) -> Iterator[tuple[range, range]]:
    """Pairs of leaves whose members may link, by size and largest overlap of all nodes above them; pairs of nodes whose members
    are ``settled`` are left out. With ``left is right``, every unordered pair within the tree comes once."""
    same_tree = left is right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        (ba, sa, ga, ea), (bb, sb, gb, eb) = left.levels[la], right.levels[lb]
        if ga[a] * 100 < PERCENT * sb[b] or gb[b] * 100 < PERCENT * sa[a]:
            continue
        if not (same_tree and a == b and la == lb):
            # Largest overlap: common bits, and shingles in both sets that share a bit with another.
            most = int(np.bitwise_count(ba[a] & bb[b]).sum()) + min(int(ea[a]), int(eb[b]))
            if most * (100 + PERCENT) < PERCENT * (int(sa[a]) + int(sb[b])):
                continue
        inner, outer = left.members(la, a), right.members(lb, b)
        if settled is not None and settled(inner, outer):
            continue
        if la == 0 and lb == 0:
            yield inner, outer
        elif la >= lb:
            if same_tree and la == lb and a == b:
                kids = left.below(la, a)
                stack += [(la - 1, i, la - 1, j) for i in kids for j in kids if i <= j][::-1]
            elif la == lb and la > 0:
                stack += [(la - 1, i, lb - 1, j) for i in left.below(la, a) for j in right.below(lb, b)]
            else:
                stack += [(la - 1, i, lb, b) for i in left.below(la, a)]
        else:
            stack += [(la, a, lb - 1, j) for j in right.below(lb, b)]


def may_link(left: Tree, inner: range, right: Tree, outer: range) -> np.ndarray:
    """Which members of two leaves may link, by their own bitmaps."""
    x, y = slice(inner.start, inner.stop), slice(outer.start, outer.stop)
    common = np.bitwise_count(left.bits[x][:, None, :] & right.bits[y][None, :, :]).sum(2)
    most = common + np.minimum(left.extra[x][:, None], right.extra[y][None, :])
    return most * (100 + PERCENT) >= PERCENT * (left.size[x][:, None] + right.size[y][None, :])


def dual_join(left: Tree, right: Tree, forest: Forest, shift: int) -> Iterator[tuple[int, int]]:
    """Links (member of left, member of right) that connect what was apart; ``shift`` is the right tree's place in the forest.

    With ``left is right``, pairs within the tree.
    """
    same_tree = left is right

    def settled(inner: range, outer: range) -> bool:
        if len(inner) + len(outer) <= 4 * LEAF:
            return len({forest.root(x) for x in inner} | {forest.root(shift + y) for y in outer}) == 1
        lab = forest.labels()
        one = lab[inner.start]
        return bool((lab[inner.start : inner.stop] == one).all() and (lab[shift + outer.start : shift + outer.stop] == one).all())

    for inner, outer in leaf_pairs(left, right, settled):
        for i, j in zip(*np.nonzero(may_link(left, inner, right, outer)), strict=True):
            p, q = inner[i], outer[j]
            if (not same_tree or p < q) and forest.root(p) != forest.root(shift + q) and linked(left.sets[p], right.sets[q]):
                forest.join(p, shift + q)
                yield p, q


_MASK = 64  # sets of a leaf where links are counted: one bit each
_ENTRIES = 1 << 17  # shingles that are looked up at once


class Overlaps:
    """Exact sizes of the intersections of leaves, from numbers of the shingles that occur in several sets."""

    def __init__(self, trees: list[Tree]) -> None:
        sets = [s for tree in trees for s in tree.sets]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        several = count[code] > 1
        kept = np.concatenate([[0], np.cumsum(several)])[at]
        code = number[code[several]]
        self.codes = [code[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)]
        self.mask = np.zeros(int(number[-1]) + 1 if len(number) else 0, U64)
        self.held = range(0)

    def hold(self, inner: range) -> None:
        """Mark the shingles of these sets (places in the list of all trees' sets)."""
        if inner != self.held:
            for k in self.held:
                self.mask[self.codes[k]] = 0
            for i, k in enumerate(inner):
                self.mask[self.codes[k]] |= U64(1 << i)
            self.held = inner

    def sizes(self, outer: range) -> np.ndarray:
        """(sets held, sets of ``outer``): sizes of the intersections."""
        owner = np.repeat(np.arange(len(outer)), [len(self.codes[k]) for k in outer])
        code = np.concatenate([self.codes[k] for k in outer])
        out = np.zeros((len(outer), _MASK), np.int64)
        for low in range(0, len(code), _ENTRIES):
            word, row = self.mask[code[low : low + _ENTRIES]], owner[low : low + _ENTRIES]
            hit = word != 0
            word, row = word[hit], row[hit]
            if len(row):
                bits = np.unpackbits(word.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        return out[:, : len(self.held)].T


def count_links(left: Tree, right: Tree, weigh_left: np.ndarray, weigh_right: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(weight of the partners of each set of left, of right, links that span the components) over all links of two trees, or
    within one. Both trees have leaves of ``_MASK`` sets."""
    same_tree = left is right
    shift = 0 if same_tree else len(left.sets)
    forest = Forest(shift + len(right.sets))
    one, two, spanning = np.zeros(len(left.sets), np.int64), np.zeros(len(right.sets), np.int64), []
    pairs = sorted(leaf_pairs(left, right), key=lambda p: (p[0].start, p[1].start))
    overlaps = Overlaps([left] if same_tree else [left, right]) if pairs else None
    for inner, outer in pairs:
        maybe = may_link(left, inner, right, outer)
        if same_tree and inner == outer:
            np.fill_diagonal(maybe, False)
        if not maybe.any():
            continue
        x, y = slice(inner.start, inner.stop), slice(outer.start, outer.stop)
        overlaps.hold(inner)
        shared = overlaps.sizes(range(shift + outer.start, shift + outer.stop))
        link = maybe & (100 * shared >= PERCENT * (left.size[x][:, None] + right.size[y][None, :] - shared))
        one[x] += link @ weigh_right[y]
        if not (same_tree and inner == outer):
            two[y] += weigh_left[x] @ link
        p, q = np.nonzero(link)
        p, q = p + inner.start, q + outer.start
        label = forest.labels()
        new = label[p] != label[shift + q]
        spanning += [(a, b) for a, b in zip(p[new].tolist(), q[new].tolist(), strict=True) if forest.join(a, shift + b)]
    return one, two, spanning


def _block_order(sets: list[np.ndarray]) -> np.ndarray:
    """Sets that are alike come together: by their smallest hashes, then by size."""
    low = np.array([[s[0], s[min(1, len(s) - 1)], len(s)] for s in sets], U64)
    return np.lexsort((low[:, 2], low[:, 1], low[:, 0]))


def link_chunk(reps: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning links of the sets of one chunk."""
    if len(sets) == 2:
        if linked(*sets):
            yield int(reps[0]), int(reps[1])
        return
    order = _block_order(sets)
    reps, sets = reps[order], [sets[k] for k in order]
    tree = Tree(sets, bitmap_width(max(map(len, sets))))
    for a, b in dual_join(tree, tree, Forest(len(sets)), 0):
        yield int(reps[a]), int(reps[b])


def link_chunks(one: tuple[np.ndarray, list, np.ndarray], two: tuple[np.ndarray, list, np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning links between two chunks, each (reps, sets, labels so far); members with one label are linked already."""
    (ra, sa, ca), (rb, sb, cb) = one, two
    a, b = np.lexsort((ca, *[_block_rank(sa)])), np.lexsort((cb, *[_block_rank(sb)]))
    width = bitmap_width(max(max(map(len, sa)), max(map(len, sb))))
    left, right = Tree([sa[k] for k in a], width), Tree([sb[k] for k in b], width)
    forest = Forest(len(a) + len(b))
    label = np.concatenate([ca[a], cb[b]])
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    forest.up = first[inverse]
    for x, y in dual_join(left, right, forest, len(a)):
        yield int(ra[a[x]]), int(rb[b[y]])


def _block_rank(sets: list[np.ndarray]) -> np.ndarray:
    rank = np.empty(len(sets), np.int64)
    rank[_block_order(sets)] = np.arange(len(sets))
    return rank


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[np.ndarray | list]]]:
    """Rows of equal keys, from batches that are sorted by them; a group never spans more memory than itself."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [batch.column(k).to_numpy() for k in keys]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(v[low].item() for v in values)
            if held and key != last:
                yield last, _unpack(held, columns)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield last, _unpack(held, columns)


def _unpack(held: list[pa.RecordBatch], columns: tuple[str, ...]) -> list:
    whole = pa.Table.from_batches(held)
    out = []
    for c in columns:
        if c == "items":
            out.append([np.frombuffer(x, U64) for x in whole.column(c).to_pylist()])
        else:
            out.append(whole.column(c).to_numpy())
    return out


def _edges(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield record(_EDGE, [p[0] for p in pairs], [p[1] for p in pairs])


def _link_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int]] = []
    for _, (reps, sets) in _groups(batches, ("block", "level", "chunk"), ("rep", "items")):
        if len(reps) > 1:
            found += link_chunk(reps, sets)
        if len(found) > 10_000:
            yield from _edges(found)
            found = []
    yield from _edges(found)


def _link_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (reps, sets, side, label) in _groups(batches, ("block", "x_level", "x_chunk", "y_level", "y_chunk"), ("rep", "items", "side", "label")):
        one, two = side == 0, side == 1
        if one.any() and two.any():
            pick = lambda m: (reps[m], [sets[k] for k in np.flatnonzero(m)], label[m])
            yield from _edges(list(link_chunks(pick(one), pick(two))))


_FOUND_SQL = "a long, b long, links long"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
_PAIR = ("block", "x_level", "x_chunk", "y_level", "y_chunk")


def _count_within_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of chunks, or single ones: (rep, d1, weight of the partners) of every set that has some, and spanning links of
    (rep, rep, null)."""
    for _, (reps, d1, sets, side, weight) in _groups(batches, _PAIR, ("rep", "d1", "items", "side", "weight")):
        # A row may be repeated in the table; a class counts once.
        _, first = np.unique(np.stack([side.astype(np.int64), reps, d1]), axis=1, return_index=True)
        if len(first) < 2:
            continue
        sides = []
        for k in (0, 1):
            own = first[side[first] == k]
            own = own[_block_order([sets[m] for m in own])] if len(own) else own
            sides.append(own)
        if not len(sides[1]):
            sides[1] = sides[0]
        elif not len(sides[0]):
            continue
        width = bitmap_width(max(len(sets[m]) for own in sides for m in own))
        trees = [Tree([sets[m] for m in own], width, _MASK) for own in sides]
        same = sides[0] is sides[1]
        if same:
            trees[1] = trees[0]
        one, two, spanning = count_links(trees[0], trees[1], weight[sides[0]], weight[sides[1]])
        if same:
            one, two = one + two, np.zeros_like(two)
        for own, links in zip(sides, (one, two), strict=True):
            some = links > 0
            if some.any():
                yield record(_FOUND, reps[own[some]], d1[own[some]], links[some])
        if spanning:
            at = np.array(spanning)
            yield record(_FOUND, reps[sides[0][at[:, 0]]], reps[sides[1][at[:, 1]]], pa.nulls(len(at), pa.int64()))


def _labelled(df: DataFrame, edges: DataFrame) -> DataFrame:
    names = components(edges)
    return df.join(names, df["rep"] == names["node"], "left").select(df["*"], F.coalesce("label", "rep").alias("label"))


_TIE_SIZES = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_TIE_SIZES_SQL = "part int, keys binary, nodes binary, sizes binary"


def lesser(size: np.ndarray) -> np.ndarray:
    """Fewest shingles that a set of this size shares with a set it links with that is no smaller."""
    return -(-2 * size * PERCENT // (100 + PERCENT))


def _window_ties(parts: int, rarity: np.ndarray, spark):
    """Prefix shingles of sets under the two windows they belong to: as a set of the window's level, and as one of the level above
    it. Sizes are negative where the shingle is in the prefix that a set shares with others no smaller."""
    sent = spark.sparkContext.broadcast(rarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, items, at in _iter_sets(batches):
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            count = sent.value[(items >> U64(40)).astype(np.int64) % SKETCH]
            order = np.lexsort((items, count, row))
            inside = np.arange(len(items)) - np.repeat(at[:-1], n)
            kept = inside < np.repeat(n - need(n) + 1, n)
            first = (inside < np.repeat(n - lesser(n) + 1, n))[kept]
            row, item = row[kept], items[order[kept]]
            level = rows.column("level").to_numpy()[row]
            key = np.concatenate([mix(item ^ mix(k.astype(U64))) for k in (level, level - 1)])
            node = np.concatenate([rows.column(c).to_numpy()[row] for c in ("own", "below")])
            size = np.concatenate([np.where(first, -n[row], n[row]), n[row]]).astype(np.int32)
            part = (key % U64(parts)).astype(np.int64)
            for p, a, b, c in deal(part, parts, key, node, size):
                yield record(_TIE_SIZES, [p], [a], [b], [c])

    return task


def _window_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: edges that tie, under every key, the sets of negative size and the others that are no smaller than one of
    them, as stars around the smallest of each component."""
    keys, nodes, sizes = [], [], []
    for b in batches:
        for held, name, kind in ((keys, "keys", U64), (nodes, "nodes", np.int64), (sizes, "sizes", np.int32)):
            held.append(np.frombuffer(string_buffer(b.column(name))[0].tobytes(), kind))
    if not keys:
        return
    key, node, size = (np.concatenate(x) for x in (keys, nodes, sizes))
    order = np.lexsort((np.abs(size), size > 0, key))
    key, node, size = key[order], node[order], size[order]
    first, run = _runs(key)
    tied = (size[first] < 0)[run] & ((size < 0) | (size >= -size[first][run]))
    names, number = np.unique(node, return_inverse=True)
    label = _merge_labels(number[first][run[tied]], number[tied], len(names))
    far = label != np.arange(len(names))
    yield record(_EDGE, names[label[far]], names[far])


def _windows(large: DataFrame, sets: DataFrame, rarity: np.ndarray, parts: int) -> DataFrame:
    """(block, window, level, rep, n, d1, members) of the sets of ``large`` (rep, n, d1, members, level): blocks of sets of the
    window's level and of the next one. A set is in up to two of them; one that nothing ties is left out, as it has no link."""
    spark = sets.sparkSession
    node = lambda k: F.xxhash64("rep", "d1", F.col("level") - k)
    levelled = sets.join(_few(large.select("rep", "d1", "level")), ["rep", "d1"]).select("rep", "level", node(0).alias("own"), node(1).alias("below"), "items")
    ties = levelled.mapInArrow(_window_ties(parts, rarity, spark), _TIE_SIZES_SQL).repartitionById(parts, F.col("part")).mapInArrow(_window_edges, _EDGE_SQL)
    blocks = components(ties).select("node", F.col("label").alias("block"))
    both = large.withColumn("window", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    both = both.withColumn("node", F.xxhash64("rep", "d1", "window"))
    return both.join(blocks, "node").select("block", "window", "level", "rep", "n", "d1", "members")


def _placed(classes: DataFrame, sets: DataFrame, parts: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(block, window, level, chunk, rep, n, d1, members) of the classes in blocks of one chunk, and of those in larger blocks under
    the blocks of their windows: in windows of one chunk, and in larger ones."""
    rarity = _sketch(sets)
    ties = sets.mapInArrow(_ties(parts, rarity, sets.sparkSession), _TIE_SQL).repartitionById(parts, F.col("part")).mapInArrow(_tie_edges, _EDGE_SQL)
    blocks = components(ties).select(F.col("node").alias("rep"), F.col("label").alias("block"))
    # Everything is planned on narrow rows; the sets join last.
    placed = cut_lineage(blocks.join(classes.select("rep", "n", "d1", "members"), "rep"))
    share = F.greatest(F.count("*") / chunk, F.sum("n") / CHUNK_ITEMS)
    size = placed.groupBy("block").agg(share.alias("share"))
    columns = ["block", "window", "level", "chunk", "rep", "n", "d1", "members"]
    alone = {c: F.lit(0) for c in ("window", "level", "chunk")}
    few = placed.join(size.filter("share <= 1"), "block").withColumns(alone).select(*columns)
    # Large blocks are cut by size of the set, in steps such that linked sets are on one level or on neighbouring ones, and by hash.
    level = F.floor(F.ln("n") / F.lit(LEVEL)).cast("int")
    large = cut_lineage(placed.join(size.filter("share > 1"), "block").select("rep", "n", "d1", "members", level.alias("level")))
    if not large.head(1):
        return few, few.limit(0), few.limit(0)
    levels = cut_lineage(_windows(large, sets, rarity, parts))
    size = levels.groupBy("block").agg(share.alias("share"))
    small = levels.join(size.filter("share <= 1"), "block").withColumn("chunk", F.lit(0)).select(*columns)
    levels = levels.join(size.filter("share > 1").select("block"), "block")
    count = levels.groupBy("block", "level").agg(F.ceil(2 * share).alias("chunks"))
    many = levels.join(count, ["block", "level"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).select(*columns)
    return few, small, cut_lineage(many)


def jaccard_components(docs: DataFrame, width: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text)."""
    rows, classes = _thin(docs, width)
    sets = cut_lineage(_candidate_sets(docs, classes, width))
    parts = parts_of(docs)
    few, small, many = _placed(classes, sets, parts, chunk)
    # The sets of the level above a window's are compared with each other in the window of their own.
    within = few.unionByName(small.withColumn("level", F.lit(0))).unionByName(many.filter("level = window"))
    links = cut_lineage(_links_within(within, sets, parts))
    if many.head(1):
        links = _link_large(many.drop("members"), sets, links, parts, chunk)
    joined = components(links)
    named = classes.join(joined, classes["rep"] == joined["node"]).select("n", "d1", "d2", "label", F.lit(0).alias("links"))
    return _answer(rows, named).drop("n_links")


def jaccard_links(docs: DataFrame, width: int = SHINGLE, chunk: int = LINK_CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows that it links with) of every row of (doc_id, text)."""
    rows, classes = _thin(docs, width)
    sets = cut_lineage(_candidate_sets(docs, classes, width))
    parts = parts_of(docs)
    few, small, many = _placed(classes, sets, parts, chunk)
    found = cut_lineage(_count_all(few, small.unionByName(many), sets, parts))
    joined = components(found.filter("links is null").select("a", "b"))
    counts = found.filter("links is not null").groupBy(F.col("a").alias("rep"), F.col("b").alias("d1")).agg(F.sum("links").alias("links"))
    named = classes.join(joined, classes["rep"] == joined["node"]).join(counts, ["rep", "d1"], "left")
    return _answer(rows, named.select("n", "d1", "d2", "label", F.coalesce("links", F.lit(0)).alias("links")))


def _count_all(few: DataFrame, many: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Counted and spanning links of all chunks, and of all pairs of chunks of a window that can hold linked sets: those of its
    level with each other and with those of the next."""
    at = F.struct("level", "chunk").alias("at")
    chunks = many.select("block", "window", at).distinct()
    one, two = chunks.filter("at.level = window").alias("p"), chunks.alias("q")
    pairs = one.join(two, (F.col("p.block") == F.col("q.block")) & (F.col("p.at") <= F.col("q.at")))
    side = lambda k, t: F.struct(F.lit(k).alias("side"), F.col(f"{t}.at").alias("at"))
    sides = F.when(F.col("p.at") == F.col("q.at"), F.array(side(0, "p"))).otherwise(F.array(side(0, "p"), side(1, "q")))
    ends = [F.col(f"{t}.at.{c}").alias(f"{n}_{c}") for t, n in (("p", "x"), ("q", "y")) for c in ("level", "chunk")]
    dealt = pairs.select(F.col("p.block").alias("block"), *ends, F.explode(sides).alias("one")).select(*_PAIR, "one.side", "one.at")
    large = dealt.join(many.select("block", at, "rep", "d1", "members"), ["block", "at"]).select(*_PAIR, "side", "rep", "d1", F.col("members").alias("weight"))
    small = few.select("block", *[F.lit(0).alias(c) for c in _PAIR[1:]], F.lit(0).alias("side"), "rep", "d1", F.col("members").alias("weight"))
    sent = sets.join(_few(small.unionByName(large)), ["rep", "d1"]).select(*_PAIR, "side", "rep", "d1", "weight", "items")
    return sent.repartition(parts, *_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(_count_within_pairs, _FOUND_SQL)


def _few(df: DataFrame) -> DataFrame:
    """The narrow rows, marked for broadcast if they are at most BROADCAST_KEYS; else the join with the sets is a shuffle."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _links_within(placed: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links inside the chunks of (rep, block, level, chunk)."""
    key = ["block", "level", "chunk"]
    rows = sets.join(_few(placed.select("rep", "d1", *key)), ["rep", "d1"]).select("rep", "items", *key)
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_link_within, _EDGE_SQL)


def _link_large(large: DataFrame, sets: DataFrame, links: DataFrame, parts: int, chunk: int) -> DataFrame:
    """Links so far and those between chunks of large blocks."""
    # One member of each component so far: chunks of a group of near copies become one component without being compared.
    state = _labelled(large, links)
    alone = state.groupBy("block", "label").agg(F.count("*").alias("members"), F.min("rep").alias("rep")).filter("members > 1")
    pivots = large.join(alone.select("block", "rep"), ["block", "rep"])
    count = pivots.groupBy("block", "level").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / CHUNK_ITEMS)).alias("chunks"))
    pivots = pivots.drop("chunk").join(count, ["block", "level"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    links = cut_lineage(links.unionByName(_links_within(pivots, sets, parts)))
    state = cut_lineage(_labelled(large, links).withColumn("at", F.struct("level", "chunk")))
    # Pairs of chunks that hold more than one component: of the window's level with each other and with those of the next.
    chunks = state.groupBy("block", "window", "at").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, two = chunks.filter("at.level = window").alias("p"), chunks.alias("q")
    apart = F.least("p.low", "q.low") != F.greatest("p.high", "q.high")
    pairs = one.join(two, (F.col("p.block") == F.col("q.block")) & (F.col("p.at") < F.col("q.at")) & apart)
    key = ["block", "x_level", "x_chunk", "y_level", "y_chunk"]
    side = lambda k, t: F.struct(F.lit(k).alias("side"), F.col(f"{t}.at").alias("at"))
    both = F.explode(F.array(side(0, "p"), side(1, "q"))).alias("one")
    sides = pairs.select(F.col("p.block").alias("block"), F.col("p.at.level").alias("x_level"), F.col("p.at.chunk").alias("x_chunk"), F.col("q.at.level").alias("y_level"), F.col("q.at.chunk").alias("y_chunk"), both).select(*key, "one.side", "one.at")
    members = sides.join(state, ["block", "at"]).select(*key, "side", "rep", "d1", "label")
    sent = sets.join(_few(members), ["rep", "d1"]).select(*key, "side", "rep", "items", "label")
    between = sent.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_link_between, _EDGE_SQL)
    return links.unionByName(cut_lineage(between))


_SALTS = 16


def _answer(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Give every row its class's component and links: those with other classes, and with the other members of its own. A class of
    copies may hold a large share of the rows, so classes with several rows stand under salted keys; classes of one row need no
    join with the rows."""
    full = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    own = rows.filter(full).groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")).join(named, ["n", "d1", "d2"], "left")
    own = own.withColumn("component_id", F.coalesce("label", "rep")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("members") - 1)
    single = own.filter("members = 1").select(F.col("rep").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    keys = own.filter("members > 1").select("n", "d1", "d2", "component_id", "n_links", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
    several = rows.filter(full).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("long")).join(keys, ["n", "d1", "d2", "salt"])
    rest = rows.filter(~full).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return single.unionByName(several.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")).unionByName(rest)


def keep_first_of_components(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id; rows without doc_id stay. All columns stay."""
    found = jaccard_components(docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    return kept


