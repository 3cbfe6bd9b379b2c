"""Conversation repair by weighted interval parsing (CYK).

The role initials of a sound conversation form ``(s?(ua)+)?``. A repair keeps, re-roles or deletes every row and may insert turns
without text. The repair grammar is in Chomsky normal form: a nonterminal [p,q] derives the rows of a span that lead from state p
of the pattern to state q, with the binary rules [p,q] -> [p,r] [r,q] and one terminal rule for every edit of one row. Inserted
turns derive from no row; their closure, at most two turns, is taken into the cells of single rows on both sides. A cell holds the
cheapest derivation of its span and nonterminal as (cost, audit), the audit being the edits' initials. Of two audits of equal
cost over the same rows neither can begin with the other, as they would differ by insertions alone and so in cost; hence the
ASCII-least audit of a span is put together from the least ones of its parts, and cells are exact.

Blocks of up to ``BLOCK`` rows get the whole chart: all spans, from short to long, over all splits, for all blocks of equal size
together. A span's cell is the same for every split, since the nonterminals name states; so longer intervals are combined from
two neighbours of doubling length, and a conversation of n rows takes n log n steps. Conversations above ``ROWS`` rows or ``BYTES``
bytes are parsed in segments by many tasks, whose cells are then combined; only their audit and the running digest of their
repaired text, both of which are single values of the output, are made in one task, by streaming.

Defined results: rows go by turn (null first), then by role and text. Null role or text counts as one blank; a null turn is no
gap. Rows without conv_id belong to no conversation and are left out. Repeated rows count as rows. Conversations named in ``ids``
but without rows have zeros and an empty audit. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import with_group_rank
from ..session import cut_lineage
from .text import parts_of, record

BLOCK = 8  # rows of a block with a whole chart
ROWS = 20_000  # rows of a conversation that one task parses
BYTES = 1 << 26  # bytes of a conversation that one task parses
_AT_ONCE = 20_000  # rows that a task parses together
_CHARTS = 1 << 10  # blocks whose charts are held at once

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; the last one for a truncated row that stays
NONE = 1 << 40  # cost of what cannot be derived
ROLES = ("user", "assistant")
#: States of the pattern: 0 start, 1 after s, 2 after u, 3 after a. The pattern may end in 0 and 3.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]
ENDS = (PAIRS.index((0, 0)), PAIRS.index((0, 3)))
INITIALS = ("", "s", "u", "a")  # codes of role initials; 0 is any other

Cells = tuple[np.ndarray, np.ndarray]  # (cost, audit), both with the nonterminals in the last axis


def better(a: Cells, b: Cells) -> Cells:
    """The cheaper, or of equal cost the ASCII-least, of two derivations."""
    pick = (b[0] < a[0]) | ((b[0] == a[0]) & (b[1] < a[1]))
    return np.where(pick, b[0], a[0]), np.where(pick, b[1], a[1])


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans by the binary rules."""
    cost, audit = [], []
    for rules in RULES:
        found = None
        for a, b in rules:
            one = left[0][..., a] + right[0][..., b], np.strings.add(left[1][..., a], right[1][..., b])
            found = one if found is None else better(found, one)
        cost.append(np.minimum(found[0], NONE))
        audit.append(np.where(found[0] < NONE, found[1], b""))
    cost, audit = np.stack(cost, -1), np.stack(audit, -1)
    return cost, audit.astype(f"S{max(1, int(np.strings.str_len(audit).max(initial=1)))}")


def _cells(found: dict[tuple[int, int], tuple[int, str]]) -> Cells:
    best = [found.get(pair, (NONE, "")) for pair in PAIRS]
    return np.array([c for c, _ in best]), np.array([a.encode() for _, a in best])


def _insertions() -> Cells:
    """Closure of the insertion rules: turns that derive from no row."""
    found = {(p, p): (0, "") for p in range(4)}
    for p, q in STEPS["u"].items():
        found[p, q] = (INSERT, "I")
    for p, q in STEPS["a"].items():
        found[p, q] = (INSERT, "I")
    for p in STEPS["u"]:
        found.setdefault((p, 3), (2 * INSERT, "II"))
    return _cells(found)


def _leaves() -> Cells:
    """Cells of a single row by its kind: 8 is a row to be deleted, others are 4 * truncated + code of the initial."""
    around, out = _insertions(), []
    for kind in range(9):
        found: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in range(4)}
        if kind < 8:
            extra = CUT_OFF * (kind // 4)
            edits = [("u", REROLE + extra, "R"), ("a", REROLE + extra, "R"), (INITIALS[kind % 4], KEEP + extra, "K")]
            for initial, cost, letter in edits:
                for pair in STEPS.get(initial, {}).items():
                    found[pair] = min(found.get(pair, (NONE, "")), (cost, letter))
        out.append(combine(combine(around, _cells(found)), around))
    width = max(a.dtype.itemsize for _, a in out)
    return np.stack([c for c, _ in out]), np.stack([a.astype(f"S{width}") for _, a in out])


LEAVES = _leaves()


def chart(kinds: np.ndarray) -> Cells:
    """Cells of whole blocks, (blocks, rows) of kinds: all spans from short to long, over all splits."""
    n = kinds.shape[1]
    spans: dict[int, Cells] = {1: (LEAVES[0][kinds], LEAVES[1][kinds])}
    for size in range(2, n + 1):
        found = None
        for cut in range(1, size):
            left = tuple(x[:, : n - size + 1] for x in spans[cut])
            right = tuple(x[:, cut : n - size + cut + 1] for x in spans[size - cut])
            one = combine(left, right)
            found = one if found is None else better(found, one)
        spans[size] = found
    return tuple(x[:, 0] for x in spans[n])


def _take(cells: list[Cells]) -> Cells:
    width = max(a.dtype.itemsize for _, a in cells)
    return np.concatenate([c for c, _ in cells]), np.concatenate([a.astype(f"S{width}") for _, a in cells])


def join_intervals(owner: np.ndarray, cells: Cells, out: list) -> None:
    """Combine neighbouring intervals of one owner until each owner has one; ``out[owner]`` receives (cost, audit)."""
    while len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))
        alone = first[count == 1]
        for at in alone:
            out[owner[at]] = cells[0][at], cells[1][at]
        rank = np.arange(len(owner)) - np.repeat(first, count)
        live = np.repeat(count > 1, count)
        left = np.flatnonzero(live & (rank % 2 == 0) & (rank + 1 < np.repeat(count, count)))
        odd = np.flatnonzero(live & (rank % 2 == 0) & (rank + 1 == np.repeat(count, count)))
        parts = [(owner[left], combine(tuple(x[left] for x in cells), tuple(x[left + 1] for x in cells))), (owner[odd], tuple(x[odd] for x in cells))]
        place = np.concatenate([left, odd])
        order = np.argsort(place)
        owner, cells = np.concatenate([o for o, _ in parts])[order], tuple(x[order] for x in _take([c for _, c in parts]))


def parse(kinds: np.ndarray, counts: np.ndarray) -> list[Cells]:
    """Cells of whole conversations, from the kinds of all their rows in a row and the (positive) numbers of rows."""
    out: list = [None] * len(counts)
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(counts) - counts, blocks) + rank * BLOCK
    size = np.minimum(BLOCK, np.repeat(counts, blocks) - rank * BLOCK)
    found, at = [], []
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        for low in range(0, len(same), _CHARTS):
            some = same[low : low + _CHARTS]
            found.append(chart(kinds[start[some][:, None] + np.arange(n)]))
            at.append(some)
    if found:
        order = np.argsort(np.concatenate(at))
        join_intervals(owner, tuple(x[order] for x in _take(found)), out)
    return out


def cheapest(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of the whole, over the states in which the pattern may end."""
    return min((int(cells[0][e]), cells[1][e].decode()) for e in ENDS)


class Editor:
    """Applies an audit to rows in order; ``rows`` may come in several calls."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.turn = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLES[self.turn], ""
            self.turn ^= 1
            self.at += 1

    def rows(self, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
        for role, text in zip(roles, texts, strict=True):
            yield from self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield (role if edit == "K" else ROLES[self.turn]), text
                self.turn = 0 if edit == "K" and role[:1] == "s" else self.turn ^ 1

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


@dataclass
class Digest:
    """SHA-256 of ``role:text`` lines."""

    state: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    begun: bool = False

    def add(self, rows: Iterator[tuple[str, str]]) -> Digest:
        for role, text in rows:
            self.state.update(f"{chr(10) * self.begun}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.begun = True
        return self

    def hex(self) -> str:
        return self.state.hexdigest()


# ---------------------------------------------------------------- rows with their faults


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial (code), blank, truncated (whatever else is wrong) and a key of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    key = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    return base.filter("conv_id is not null").select(
        "*", initial.cast("int").alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), key.alias("key")
    )


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True
MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", audit string, repaired_sha256 string"
_REPORT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS_SCHEMA = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by conversation, in tables that hold whole conversations and about ``_AT_ONCE`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < _AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("conv_id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))  # the last conversation may go on
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _flag(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _repeated(owner: np.ndarray, key: pa.ChunkedArray) -> np.ndarray:
    """Whether a row's owner has had its key before."""
    if not len(owner):
        return np.zeros(0, bool)
    words = np.frombuffer(b"".join(key.to_pylist()), np.int64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0], owner))  # stable: rows of one key stay in order
    same = np.zeros(len(owner), bool)
    a, b = order[:-1], order[1:]
    same[b] = (owner[a] == owner[b]) & (words[a] == words[b]).all(1)
    return same


def _kinds(blank: np.ndarray, duplicate: np.ndarray, truncated: np.ndarray, initial: np.ndarray) -> np.ndarray:
    return np.where(blank | duplicate, 8, 4 * truncated + initial)


def _illegal(initial: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows whose initial must not follow the one before in the same conversation."""
    out = np.zeros(len(initial), bool)
    out[1:] = (owner[1:] == owner[:-1]) & ~_LEGAL[initial[:-1], initial[1:]]
    return out


def _gaps(owner: np.ndarray, turn: pa.ChunkedArray, n: int) -> np.ndarray:
    """maxTurn - minTurn + 1 - distinct turns of every owner, for rows sorted by turn; nulls are ignored."""
    known = turn.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    owner, turn = owner[known], turn.drop_null().to_numpy()
    out = np.zeros(n, np.int64)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (turn[1:] != turn[:-1]))
        out[owner[first]] = turn[last] - turn[first] + 1 - np.add.reduceat(fresh, first, dtype=np.int64)
    return out


def _task(emit_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parses conversations that fit a task, from rows sorted by (conv_id, turn, role, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_conversations(batches):
            ids, owner = np.unique(table.column("conv_id").to_numpy(), return_inverse=True)
            there = ~_flag(table, "gone")
            owner, rows = owner[there], table.filter(pa.array(there))
            n = len(ids)
            blank, truncated, initial = _flag(rows, "blank"), _flag(rows, "truncated"), rows.column("initial").to_numpy()
            duplicate = ~blank & _repeated(owner, rows.column("key"))
            truncated &= ~(blank | duplicate)
            counts = np.bincount(owner, minlength=n)
            full = np.flatnonzero(counts)
            best: list[tuple[int, str]] = [(0, "")] * n
            for k, cells in zip(full, parse(_kinds(blank, duplicate, truncated, initial), counts[full]), strict=True):
                best[k] = cheapest(cells)
            roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
            end = np.cumsum(counts)
            spans = list(zip((end - counts).tolist(), end.tolist(), strict=True))
            if emit_rows:
                out = []
                for key, (a, b), (_, audit) in zip(ids.tolist(), spans, best, strict=True):
                    editor = Editor(audit)
                    out += [(key, place, *row) for place, row in enumerate([*editor.rows(roles[a:b], texts[a:b]), *editor.rest()])]
                if out:
                    yield record(_ROWS_SCHEMA, *zip(*out, strict=True))
                continue
            digests = []
            for (a, b), (_, audit) in zip(spans, best, strict=True):
                editor = Editor(audit)
                digests.append(Digest().add(editor.rows(roles[a:b], texts[a:b])).add(editor.rest()).hex())
            tallies = [np.bincount(owner[x], minlength=n) for x in (blank, duplicate, truncated, _illegal(initial, owner))]
            yield record(_REPORT_SCHEMA, ids, _gaps(owner, rows.column("turn"), n), *tallies, [c for c, _ in best], [a for _, a in best], digests)

    return task


# ---------------------------------------------------------------- conversations above the limits


def _ranked(rows: DataFrame) -> DataFrame:
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return with_group_rank(rows, ["conv_id"], order, "pos")


_SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), *((m, pa.int64()) for m in ("blank", "duplicate", "truncated", "illegal")), ("ends", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.binary()))])
_SEGMENT = "conv_id long, seg long, blank long, duplicate long, truncated long, illegal long, ends array<long>, costs array<long>, audits array<binary>"


def _segments(ranked: DataFrame, size: int) -> DataFrame:
    """One row a segment: its counts, its first and last initial, and its cells."""
    firsts = ranked.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(False).alias("repeats"))
    marked = ranked.drop("role", "text", "key", "turn").join(firsts, ["conv_id", "pos"], "left")
    rows = marked.withColumns({"repeats": F.coalesce("repeats", F.lit(True)), "seg": F.floor(F.col("pos") / size)})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < size:
                continue
            seg, conv = held.column("seg").to_numpy(), held.column("conv_id").to_numpy()
            last = np.flatnonzero((seg != seg[-1]) | (conv != conv[-1]))
            if len(last):
                yield from cells_of(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield from cells_of(held)

    def cells_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        conv, seg = table.column("conv_id").to_numpy(), table.column("seg").to_numpy()
        first = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (seg[1:] != seg[:-1])))
        counts = np.diff(np.append(first, len(conv)))
        owner = np.repeat(np.arange(len(first)), counts)
        blank, truncated, initial = _flag(table, "blank"), _flag(table, "truncated"), table.column("initial").to_numpy()
        duplicate = ~blank & _flag(table, "repeats")
        truncated &= ~(blank | duplicate)
        cells = parse(_kinds(blank, duplicate, truncated, initial), counts)
        tallies = [np.bincount(owner[x], minlength=len(first)) for x in (blank, duplicate, truncated, _illegal(initial, owner))]
        ends = np.stack([initial[first], initial[first + counts - 1]], 1).tolist()
        yield record(_SEGMENT_SCHEMA, conv[first], seg[first], *tallies, ends, [c.tolist() for c, _ in cells], [a.tolist() for _, a in cells])

    return rows.repartition(parts_of(rows), "conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(task, _SEGMENT)


def _audits(segments: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit: the cells of a conversation's segments combined."""
    schema = pa.schema([("conv_id", pa.int64()), *((m, pa.int64()) for m in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            illegal = sum(r["illegal"] for r in held) + sum(not _LEGAL[a["ends"][1], b["ends"][0]] for a, b in zip(held[:-1], held[1:], strict=True))
            cells = _take([(np.array([r["costs"]]), np.array([r["audits"]], "S")) for r in held])
            out: list = [None]
            join_intervals(np.zeros(len(held), np.int64), cells, out)
            cost, audit = cheapest(out[0])
            return record(schema, [held[0]["conv_id"]], *([sum(r[m] for r in held)] for m in ("blank", "duplicate", "truncated")), [illegal], [cost], [audit])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    ordered = segments.repartition(parts_of(segments), "conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(task, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(ranked: DataFrame, audits: DataFrame, emit_rows: bool) -> DataFrame:
    """Digests, or rows, of repaired conversations: the audit goes before the rows, which then stream through."""
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = head.unionByName(ranked.select("conv_id", "pos", "role", "text"))
    digest_schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, editor, digest, place = None, Editor(""), Digest(), 0

        def put(some: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            if not emit_rows:
                digest.add(some)
                return
            out = [(now, place + k, *row) for k, row in enumerate(some)]
            place += len(out)
            if out:
                yield record(_ROWS_SCHEMA, *zip(*out, strict=True))

        def finish() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield from put(editor.rest())
                if not emit_rows:
                    yield record(digest_schema, [now], [digest.hex()])

        for batch in batches:
            keys, pos, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text"))
            low = 0
            for k in [*(k for k, p in enumerate(pos) if p == -1), len(pos)]:
                if k > low:
                    yield from put(editor.rows(roles[low:k], texts[low:k]))
                if k < len(pos):
                    yield from finish()
                    now, editor, digest, place = keys[k], Editor(texts[k]), Digest(), 0
                low = k + 1
        yield from finish()

    sql = "conv_id long, place long, role string, text string" if emit_rows else "conv_id long, repaired_sha256 string"
    return rows.repartition(parts_of(rows), "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(task, sql)


def _large_report(rows: DataFrame, size: int) -> DataFrame:
    ranked = cut_lineage(_ranked(rows))
    audits = cut_lineage(_audits(_segments(ranked, size)))
    turns = ranked.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    joined = audits.join(gaps, "conv_id", "left").join(_edited(ranked, audits, False), "conv_id")
    return joined.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *MEASURES[1:], "audit", "repaired_sha256")


def _split(rows: DataFrame, max_rows: int, max_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that fit a task, and of the others."""
    size = F.sum(F.octet_length("role") + F.octet_length("text"))
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("size")).filter((F.col("n") > max_rows) | (F.col("size") > max_bytes))
    large = cut_lineage(counts.select("conv_id"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, "conv_id", "left_anti"), rows.join(large, "conv_id", "left_semi")


def _together(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("gone", F.lit(False))
    if ids is not None:
        names = ids.select(F.col("conv_id").cast("long")).filter("conv_id is not null").distinct()
        empty = [F.lit(True if c == "gone" else None).cast(dict(rows.dtypes)[c]).alias(c) for c in rows.columns if c != "conv_id"]
        rows = rows.unionByName(names.select("conv_id", *empty))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition(parts_of(rows), "conv_id").sortWithinPartitions(*order)


def repair_report(turns: DataFrame, ids: DataFrame | None = None, max_rows: int = ROWS, max_bytes: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``turns``, and of
    those of ``ids`` that have no rows."""
    small, large = _split(with_faults(turns), max_rows, max_bytes)
    if large is None:
        return _together(small, ids).mapInArrow(_task(False), REPORT)
    more = _large_report(large, max_rows)
    if ids is not None:
        ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).join(more.select("conv_id"), "conv_id", "left_anti")
    return _together(small, ids).mapInArrow(_task(False), REPORT).unionByName(more)


def repaired_turns(turns: DataFrame, max_rows: int = ROWS, max_bytes: int = BYTES) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations."""
    sql = "conv_id long, place long, role string, text string"
    small, large = _split(with_faults(turns), max_rows, max_bytes)
    out = _together(small, None).mapInArrow(_task(True), sql)
    if large is None:
        return out
    ranked = cut_lineage(_ranked(large))
    return out.unionByName(_edited(ranked, _audits(_segments(ranked, max_rows)), True))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, 3 repeats it, 4 makes it the user's. Null values count as one blank; a null turn stays null in the result."""
    role, text, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "turn"))
    code: Column = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).filter("code <> 0")
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")
