"""Prefix trie of conversations as flat node tables with minimal perfect hashing.

A node is a distinct sequence of first turns. Its digest is a sum over its turns of 128-bit turn keys times powers of an odd number,
so digests of all prefixes come from running sums, also where a conversation is cut into segments of ``SEGMENT`` turns that lie in
different tasks. Distinct digests are enumerated in shards by hash; in a shard, a minimal perfect hash gives every digest a slot of
flat arrays, each look-up is verified by the digest stored in the slot, and member counts, smallest members and the nodes' own
data are scattered there (contradicting data of one digest raise).

Sums over subtrees need no round per level across the cluster. Every node belongs to its smallest member, and the nodes of one
member are an unbroken end of its path. A shard of paths holds, for all nodes on them, their slots and their parents' slots; each
node's own leaf and saved tokens are scattered by its owner alone, and one sweep from the deepest level upward adds every slot to
its parent's. Totals of nodes that lie in several shards are added by digest. What later segments of a path contribute enters
at the end of the earlier ones.

Defined results: null role or text counts as empty. Rows go by turn (null first), then role and the key of (role, text); repeated rows
count as turns. Rows without conv_id are left out. An empty table has no root and gives no rows. Other columns are ignored. The digest
of a node's end members is sequential by definition: their ids are joined in sorted runs by many tasks, and one task streams the runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import with_group_rank
from ..session import cut_lineage
from .text import U64, mix, parts_of, record

SEGMENT = 4096  # turns of a path in one row
SHARD_NODES = 1 << 19  # prefixes in one shard, about
HEAD = 5  # most turns that a rebuilt conversation takes from another one
_SALTS = 256
_STEP = 0xD1342543DE82EF95  # odd
_HALF = U64(0xFFFFFFFF)


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, each verified by the digest stored there.

    Level by level, digests that fall alone on a position of a table twice their number stay there; the others go on."""

    def __init__(self, d0: np.ndarray, d1: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.d0, self.d1 = np.empty(len(d0), U64), np.empty(len(d0), U64)
        base = 0
        while len(d0):
            at = self._positions(len(self.levels), 2 * len(d0), d0, d1)
            alone = np.bincount(at, minlength=2 * len(d0)) == 1
            slot = base + np.cumsum(alone) - 1
            self.levels.append((alone, slot))
            here = alone[at]
            self.d0[slot[at[here]]], self.d1[slot[at[here]]] = d0[here], d1[here]
            base += int(here.sum())
            d0, d1 = d0[~here], d1[~here]

    @staticmethod
    def _positions(level: int, size: int, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        return (mix(mix(d0 + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ d1) % U64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.d0)

    def slots(self, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where it is not in the table."""
        out = np.full(len(d0), -1, np.int64)
        left = np.arange(len(d0))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._positions(level, len(alone), d0[left], d1[left])
            hit = alone[at]
            found = slot[at[hit]]
            same = (self.d0[found] == d0[left[hit]]) & (self.d1[found] == d1[left[hit]])
            out[left[hit]] = np.where(same, found, -1)
            left = left[~hit]
        return out


def distinct(d0: np.ndarray, d1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((d1, d0))
    a, b = d0[order], d1[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[fresh], b[fresh]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _power(n: int) -> int:
    return pow(_STEP, n, 1 << 64)


def _powers(start: int, n: int) -> np.ndarray:
    out = np.full(n, _STEP, U64)
    if n:
        out[0] = _power(start)
    return np.multiply.accumulate(out)


# ---------------------------------------------------------------- paths


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key (16 bytes) and size (code points) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).alias("size"))
    ranked = with_group_rank(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")], "pos")
    return ranked.select("conv_id", "pos", "key", "size")


def _items(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "size"))).alias("items"))


def _no_items() -> Column:
    return F.array().cast("array<struct<pos:bigint,key:binary,size:int>>")


def whole_paths(keys: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, seg, start, items: the turns of each conversation in segments, which begin at the same depths in all of them."""
    own = _items(keys.withColumn("seg", F.floor(F.col("pos") / segment)), ["conv_id", "seg"])
    return own.select("conv_id", "seg", (F.col("seg") * segment).alias("start"), "items")


def rebuilt_paths(keys: DataFrame, every: int = 100, segment: int = SEGMENT) -> DataFrame:
    """As ``whole_paths`` for conversations whose first h turns are replaced by those of the conversation ``every`` multiple below,
    h = crc32(conv_id as text) mod (HEAD + 1)."""
    if segment < HEAD:
        raise ValueError(f"segments must have room for {HEAD} turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("long")
    lent = _items(keys.filter((F.col("pos") < HEAD) & (F.pmod("conv_id", F.lit(every)) == 0)), ["conv_id"])  # HEAD turns at most
    lent = lent.select(F.col("conv_id").alias("base"), F.col("items").alias("lent"))
    convs = keys.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base"))
    taken = F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), _no_items())
    heads = convs.join(lent, "base", "left").select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("start"), taken.alias("items"))
    rest = keys.withColumn("part", F.floor((F.col("pos") - h) / segment)).filter("part >= 0")
    own = _items(rest, ["conv_id", "part"]).join(heads.select("conv_id", F.size("items").alias("before")), "conv_id")
    # A part lies across one beginning of a segment at most, as it is no longer than one.
    start = F.col("before") + F.col("part") * segment
    room = (F.lit(segment) - F.pmod(start, F.lit(segment))).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("more"), F.slice("items", F.lit(1), room).alias("items")), F.struct(F.lit(1).alias("more"), F.slice("items", room + 1, F.lit(segment)).alias("items")))
    dealt = own.select("conv_id", start.alias("start"), F.explode(halves).alias("half")).filter("size(half.items) > 0")
    dealt = dealt.select("conv_id", (F.floor(F.col("start") / segment) + F.col("half.more")).alias("seg"), (F.col("start") + F.col("half.more")).alias("start"), "half.items")
    lists = F.array_sort(F.collect_list(F.struct("start", F.size("items").alias("n"), "items")))
    grouped = heads.unionByName(dealt).groupBy("conv_id", "seg").agg(F.flatten(F.transform(lists, lambda x: x["items"])).alias("items"))
    return grouped.select("conv_id", "seg", (F.col("seg") * segment).alias("start"), "items")


_TERM_SQL = "conv_id long, seg long, start long, n long, h0 long, h1 long, h2 long, h3 long, terms binary, sizes binary"
_TERM_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("conv_id", "seg", "start", "n", "h0", "h1", "h2", "h3")), ("terms", pa.binary()), ("sizes", pa.binary())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every turn's part of the digests, and the halves of their sums (which add up without overflow)."""
    for batch in batches:
        rows = []
        for conv, seg, start, items in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "start", "items")), strict=True):
            lanes = np.frombuffer(b"".join(i["key"] for i in items), U64).reshape(-1, 2)
            terms = mix(lanes) * _powers(start, len(items))[:, None]
            total = terms.sum(0, dtype=U64)
            halves = [int(x) for t in total for x in (t & _HALF, t >> U64(32))]
            rows.append((conv, seg, start, len(items), *halves, terms.tobytes(), np.array([i["size"] for i in items], np.int64).tobytes()))
        if rows:
            yield record(_TERM_SCHEMA, *zip(*rows, strict=True))


_PATH_SQL = "conv_id long, seg long, start long, n long, before binary, digests binary, checks binary, sizes binary, e0 long, e1 long"
_PATH_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("conv_id", "seg", "start", "n")), *((c, pa.binary()) for c in ("before", "digests", "checks", "sizes")), ("e0", pa.int64()), ("e1", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all prefixes that end in a segment, the digest before it, and the path's end where this is its last segment."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            halves = np.array([r[f"b{k}"] or 0 for k in range(4)]).astype(U64)
            before = halves[0::2] + (halves[1::2] << U64(32))
            terms = np.frombuffer(r["terms"], U64).reshape(-1, 2)
            digests = before + np.cumsum(terms, 0, dtype=U64)
            end = (digests[-1] if r["n"] else before).view(np.int64).tolist() if r["last"] else (None, None)
            rows.append((r["conv_id"], r["seg"], r["start"], r["n"], before.tobytes(), digests.tobytes(), terms[:, 0].tobytes(), r["sizes"], *end))
        if rows:
            yield record(_PATH_SCHEMA, *zip(*rows, strict=True))


def prefix_paths(segments: DataFrame) -> DataFrame:
    """Paths with the digests of all prefixes, written for the passes that follow."""
    terms = cut_lineage(segments.mapInArrow(_terms, _TERM_SQL))
    order = Window.partitionBy("conv_id").orderBy("seg")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(f"h{k}").over(earlier).alias(f"b{k}") for k in range(4)]
    offsets = terms.select("conv_id", "seg", *sums, F.lead("seg").over(order).isNull().alias("last"))  # a few numbers a segment
    joined = terms.select("conv_id", "seg", "start", "n", "terms", "sizes").join(offsets, ["conv_id", "seg"])
    return cut_lineage(joined.mapInArrow(_digests, _PATH_SQL))


def _unpack(table: pa.Table) -> dict[str, np.ndarray]:
    """Nodes on the paths of a table, segment by segment; the first one of a path begins with the root. ``parent`` is the row before in
    the path, -1 at a segment's beginning; ``row`` is the segment."""
    start, n, seg = (_numbers(table.column(c)) for c in ("start", "n", "seg"))
    raw = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), U64 if c in ("before", "digests", "checks") else np.int64) for c in ("before", "digests", "checks", "sizes")}
    before, digests = raw["before"].reshape(-1, 2), raw["digests"].reshape(-1, 2)
    head = (seg == 0).astype(np.int64)  # the root takes one place more
    count = n + head
    end = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(int(count.sum())) - np.repeat(end - count, count)  # within the segment
    root = (place == 0) & (head[row] == 1)
    out = {"row": row, "depth": start[row] + place + 1 - head[row], "root": root}
    lanes = np.zeros((len(row), 2), U64)
    lanes[~root] = digests
    above = np.zeros((len(row), 2), U64)
    above[1:] = lanes[:-1]
    first = end - count
    first, has = first[count > 0], count > 0
    above[first] = before[has]
    parent = np.arange(len(row)) - 1
    parent[first] = -1
    above[root] = 0
    for name, values, kind in (("check", raw["checks"], U64), ("size", raw["sizes"], np.int64)):
        out[name] = np.zeros(len(row), kind)
        out[name][~root] = values
    return out | {"d0": lanes[:, 0], "d1": lanes[:, 1], "p0": above[:, 0], "p1": above[:, 1], "parent": parent}


# ---------------------------------------------------------------- nodes


_NODE_COLUMNS = ("d0", "d1", "p0", "p1", "depth", "size", "check", "n_convs", "owner", "seg")
_NODE_SQL = ", ".join(f"`{c}` long" for c in _NODE_COLUMNS)
_NODE_SCHEMA = pa.schema([(c, pa.int64()) for c in _NODE_COLUMNS])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x


def merge_nodes(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One entry a digest from rows of ``_NODE_COLUMNS``: counts and smallest members scattered into slots."""
    table = SlotTable(*distinct(rows["d0"], rows["d1"]))
    slot = table.slots(rows["d0"], rows["d1"])
    out = {"d0": table.d0, "d1": table.d1}
    for name in ("p0", "p1", "depth", "size", "check"):
        out[name] = np.zeros(len(table), rows[name].dtype)
        out[name][slot] = rows[name]
        if (out[name][slot] != rows[name]).any():
            raise ValueError("two different prefixes have one digest")
    out["n_convs"] = np.zeros(len(table), np.int64)
    np.add.at(out["n_convs"], slot, rows["n_convs"])
    out["owner"] = np.full(len(table), np.iinfo(np.int64).max)
    np.minimum.at(out["owner"], slot, rows["owner"])
    out["seg"] = np.zeros(len(table), np.int64)
    own = out["owner"][slot] == rows["owner"]
    out["seg"][slot[own]] = rows["seg"][own]
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the paths of each batch, merged."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rows = _unpack(table)
        if not len(rows["row"]):
            continue
        rows["n_convs"] = np.ones(len(rows["row"]), np.int64)
        rows["owner"], rows["seg"] = (_numbers(table.column(c))[rows["row"]] for c in ("conv_id", "seg"))
        merged = merge_nodes(rows)
        yield record(_NODE_SCHEMA, *(_signed(merged[c]) for c in _NODE_COLUMNS))


def _node_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        rows = {c: _numbers(table.column(c)) for c in _NODE_COLUMNS}
        rows |= {c: rows[c].view(U64) for c in ("d0", "d1", "p0", "p1", "check")}
        merged = merge_nodes(rows)
        yield record(_NODE_SCHEMA, *(_signed(merged[c]) for c in _NODE_COLUMNS))


# ---------------------------------------------------------------- sums over subtrees


_SUM_SQL = "d0 long, d1 long, n_leaves long, saved_tokens long"
_SUM_SCHEMA = pa.schema([(c, pa.int64()) for c in ("d0", "d1", "n_leaves", "saved_tokens")])


def _subtree_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of all nodes on a shard's paths."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    segments = pa.Table.from_batches(held).combine_chunks()
    rows = _unpack(segments)
    table = SlotTable(*distinct(rows["d0"], rows["d1"]))
    slot = table.slots(rows["d0"], rows["d1"])
    parent = np.full(len(table), -1, np.int64)
    inner = rows["parent"] >= 0
    parent[slot[inner]] = slot[rows["parent"][inner]]
    depth = np.zeros(len(table), np.int64)
    depth[slot] = rows["depth"]
    totals = np.zeros((len(table), 2), np.int64)
    # Own values of the nodes that belong to the segment's path, by depth; what lies below the segment comes in at its end.
    first = np.searchsorted(rows["row"], np.arange(segments.num_rows))
    last = np.searchsorted(rows["row"], np.arange(segments.num_rows), "right") - 1
    lists = segments.column("owned").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), _numbers(lists.value_lengths().fill_null(0)))
    cells = lists.flatten()
    owned_depth, leaf, saved = (_numbers(cells.field(c)) for c in ("depth", "leaf", "saved"))
    at = slot[first[owner] + owned_depth - rows["depth"][first[owner]]] if len(owner) else np.zeros(0, np.int64)
    np.add.at(totals, at, np.stack([leaf, saved], 1).astype(np.int64))
    below = np.stack([_numbers(segments.column(c)) for c in ("below_leaves", "below_saved")], 1)
    some = np.flatnonzero(below.any(1) & (last >= first))
    np.add.at(totals, slot[last[some]], below[some])
    order = np.argsort(-depth, kind="stable")
    cut = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cut):  # from the deepest level upward
        level = level[parent[level] >= 0]
        np.add.at(totals, parent[level], totals[level])
    keep = totals.any(1)
    yield record(_SUM_SCHEMA, _signed(table.d0[keep]), _signed(table.d1[keep]), totals[keep, 0], totals[keep, 1])


def _subtree_sums(nodes: DataFrame, paths: DataFrame, shards: int) -> DataFrame:
    """d0, d1, n_leaves, saved_tokens from nodes with n_children."""
    values = nodes.select("owner", "seg", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    lists = F.collect_list(F.struct("depth", "leaf", "saved")).alias("owned")  # a segment's nodes at most
    owned = values.groupBy(F.col("owner").alias("conv_id"), "seg").agg(lists, F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
    compact = paths.select("conv_id", "seg").join(owned.select("conv_id", "seg", "leaves", "saved"), ["conv_id", "seg"], "left")
    below = [F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"below_{c}") for c in ("leaves", "saved")]
    needed = compact.select("conv_id", "seg", *below, F.coalesce("leaves", F.count("leaves").over(later) - 1).alias("own")).filter("own >= 0").drop("own")
    rows = paths.drop("e0", "e1").join(needed, ["conv_id", "seg"]).join(owned.select("conv_id", "seg", "owned"), ["conv_id", "seg"], "left")
    dealt = rows.repartition(shards, F.floor(F.col("conv_id") / 100), "seg")
    partial = dealt.mapInArrow(_subtree_shard, _SUM_SQL)
    return partial.groupBy("d0", "d1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


# ---------------------------------------------------------------- end members


_RUN_SCHEMA = pa.schema([("d0", pa.int64()), ("d1", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of every node in each batch, as one text a node."""
    for batch in batches:
        d0, d1, ids = (_numbers(batch.column(c)) for c in ("e0", "e1", "conv_id"))
        order = np.lexsort((ids, d1, d0))
        d0, d1, ids = d0[order], d1[order], ids[order]
        first = np.flatnonzero(np.append(True, (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1]))) if len(ids) else np.zeros(0, int)
        texts = [",".join(map(str, run.tolist())) for run in np.split(ids, first[1:])] if len(ids) else []
        yield record(_RUN_SCHEMA, d0[first], d1[first], ids[first], texts)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each node, which arrive in order."""
    schema = pa.schema([("d0", pa.int64()), ("d1", pa.int64()), ("ends_sha256", pa.string())])
    now, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for d0, d1, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now == (d0, d1):
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (d0, d1), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield record(schema, *zip(*done, strict=True))
    if now is not None:
        yield record(schema, [now[0]], [now[1]], [state.hexdigest()])


def _end_digests(paths: DataFrame) -> DataFrame:
    ends = paths.filter("e0 is not null").select("e0", "e1", "conv_id")
    runs = ends.repartitionByRange(parts_of(paths), "conv_id").sortWithinPartitions("conv_id").mapInArrow(_id_runs, "d0 long, d1 long, first long, ids string")
    return runs.repartition(parts_of(paths), "d0", "d1").sortWithinPartitions("d0", "d1", "first").mapInArrow(_hash_runs, "d0 long, d1 long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(segments: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of
    the conversations given as ``whole_paths`` or ``rebuilt_paths``."""
    paths = prefix_paths(segments)
    prefixes = paths.agg(F.sum("n") + F.count("*")).first()[0] or 0
    shards = max(parts_of(paths), -(-prefixes // shard_nodes))
    merged = paths.mapInArrow(_occurrences, _NODE_SQL).repartition(shards, "d0", "d1").mapInArrow(_node_shard, _NODE_SQL)
    nodes = cut_lineage(merged.drop("check"))
    digest = ["d0", "d1"]
    below_root = nodes.filter("depth > 0")
    children = below_root.groupBy(F.col("p0").alias("d0"), F.col("p1").alias("d1")).agg(F.count("*").alias("n_children"))
    counted = cut_lineage(nodes.join(children, digest, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # A node may have any number of children: their questions for its smallest member are made distinct before the join.
    salt = F.pmod(F.col("owner"), F.lit(_SALTS)).alias("salt")
    asked = below_root.select("p0", "p1", salt).distinct()
    owners = nodes.select(F.col("d0").alias("p0"), F.col("d1").alias("p1"), F.col("owner").alias("parent_conv_id"))
    answers = asked.join(owners, ["p0", "p1"])
    parents = below_root.select(*digest, "p0", "p1", salt).join(answers, ["p0", "p1", "salt"]).select(*digest, "parent_conv_id")
    sums = _subtree_sums(counted, paths, shards)
    out = counted.join(parents, digest, "left").join(sums, digest, "left").join(_end_digests(paths), digest, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_leaves", "saved_tokens")),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """The trie of a table of turns, as it is or with rebuilt conversations."""
    keys = cut_lineage(turn_keys(conversations))
    return prefix_trie(rebuilt_paths(keys) if rebuilt else whole_paths(keys))
