"""Language model scoring: a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of the token in its class. Classes of
frequent words hold ``MEMBERS`` words each, in order of frequency; all other words fall into classes by a hash of their ending,
where a word has its smoothed share of the class's counts, with one share left for all words never seen. Class scores are
sums over hashed features of the history (one and two words before, the pair, the skip to the third, and the class before) and
a bias; frequent words within a class have a score for every class before. Weights are learned by distributed gradient updates:
in every round the tasks run over their part of the training rows from the same weights and the changes are averaged. Each round
has its own share of the rows, by a hash of id and text, and the rounds together cover every training row. The table of hashed
features grows with the cube root of the number of training tokens, so that what all tasks send stays in proportion to the input.

Counts are exact and cover all training documents: words travel as 64-bit hashes with counts, combined in the tasks, and every
document gets the counts of its own words back, so no vocabulary is ever in one place. Only the counts of the most frequent
words (a fixed number) are broadcast, which keeps common words out of the exchange. Two words are one if their hashes are equal.

Defined results: a null text is empty: one token, its end. Repeated rows teach, and are answered, as often as they occur. Rows
without doc_id are held out of nothing and teach. With no training document, counts are zero and all words are unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import ARRAY_ROWS, LOWER, U64, array_rows, deal, mix, parts_of, record, remainder, string_buffer, sum_arrays, text_blocks, word_bounds, word_hashes

END = U64(0x2545F4914F6CDD1D)  # the token after the last word
START = U64(0x9E6C63D0876A9A47)  # stands before the first word; never scored
FREQUENT = 1 << 16  # most frequent words whose counts are broadcast (16 bytes each)
MEMBERS, FREQUENT_CLASSES, ENDING_CLASSES = 32, 32, 64
CLASSES = FREQUENT_CLASSES + ENDING_CLASSES
BUCKETS, GROWTH = 1 << 12, 4  # rows of hashed features: BUCKETS, and GROWTH times the cube root of the training tokens
LANES = 1 << 10  # tokens whose scores are computed at once
FEATURES = 5
ROUNDS, RATE, PASS_TOKENS = 3, 0.4, 4096
ALPHA = 0.1
GATHERED = 1 << 21  # distinct (document, word) pairs that a task gathers before it sends them


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out")


# --- tokens ------------------------------------------------------------------------------------------------------------------


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each row, hash of each token's last two bytes, n + 1 positions) of a block."""
    words, at = word_hashes(data, offsets)
    starts, ends, _ = word_bounds(data, offsets)
    n = len(offsets) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))
    out = np.full(len(words) + n, END)
    out[place] = words
    low = LOWER[data]
    ending = np.zeros(len(out), np.int64)
    if len(words):
        last = low[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        ending[place] = last * 256 + before
    return out, ending, at + np.arange(n + 1)


def ending_class(ending: np.ndarray) -> np.ndarray:
    return FREQUENT_CLASSES + (mix(ending.astype(U64)) % U64(ENDING_CLASSES)).astype(np.int64)


# --- counts -------------------------------------------------------------------------------------------------------------------

_COUNT_SQL = "part int, words binary, counts binary, endings binary"
_COUNT = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary())])


def _count_words(parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            word, count, ending = (np.concatenate(x) for x in zip(*held, strict=True))
            name, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            return name, np.bincount(inverse, weights=count).astype(np.int64), ending[first]

        def send():
            word, count, ending = merged()
            part = (word % U64(parts)).astype(np.int64)
            for p, *blobs in deal(part, parts, word, count, ending):
                yield record(_COUNT, [p], *([b] for b in blobs))

        for _, data, offsets in text_blocks(batches):
            word, ending, _ = token_stream(data, offsets)
            name, first, count = np.unique(word, return_index=True, return_counts=True)
            held.append((name, count, ending[first]))
            size += len(name)
            if size > GATHERED:
                one = merged()
                held, size = [one], len(one[0])
                if size > GATHERED // 2:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    return task


def _concat(batches: Iterator[pa.RecordBatch], columns: dict[str, type]) -> list[np.ndarray]:
    held = [[np.frombuffer(string_buffer(b.column(c))[0].tobytes(), t) for c, t in columns.items()] for b in batches]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, t) for t in columns.values()]


_COUNT_TYPES = {"words": U64, "counts": np.int64, "endings": np.int64}


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the words of one hash range, as one row."""
    held = list(batches)
    if held:
        part = held[0].column("part")[0].as_py()
        word, count, ending = _concat(iter(held), _COUNT_TYPES)
        name, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=count).astype(np.int64)
        yield record(_COUNT, [part], [name.tobytes()], [total.tobytes()], [ending[first].tobytes()])


def training_counts(docs: DataFrame) -> DataFrame:
    """part, words, counts, endings: all training words with their counts, one row for each of a fixed number of hash ranges."""
    parts = parts_of(docs)
    rows = docs.filter(~held_out()).select("text")
    sent = rows.mapInArrow(_count_words(parts), _COUNT_SQL)
    return cut_lineage(sent.repartitionById(parts, F.col("part")).mapInArrow(_add_counts, _COUNT_SQL))


class Totals:
    """What is broadcast about the counts: N, V, the most frequent words, and sums of the classes. Its size is fixed."""

    def __init__(self, n: int, distinct: int, words: np.ndarray, counts: np.ndarray, class_counts: np.ndarray, class_words: np.ndarray) -> None:
        self.n, self.distinct = n, distinct
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        by_count = np.lexsort((words, -counts))[: MEMBERS * FREQUENT_CLASSES]
        self.slot = np.full(len(words), -1, np.int64)  # of the sorted words
        where = np.empty(len(words), np.int64)
        where[order] = np.arange(len(words))
        self.slot[where[by_count]] = np.arange(len(by_count))
        self.slots = len(by_count)
        self.class_counts, self.class_words = class_counts, class_words

    def lookup(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, slot or -1) of tokens among the most frequent words."""
        if not len(self.words):
            return np.full(len(tokens), -1), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        hit = self.words[at] == tokens
        return np.where(hit, self.counts[at], -1), np.where(hit, self.slot[at], -1)


def totals_of(counts: DataFrame) -> Totals:
    """Sums and the most frequent words: every range sends its own most frequent ones and its sums, nothing else."""
    # Hash ranges hold about equal numbers of the frequent words; each sends twice its share.
    most = 64 + 2 * FREQUENT // parts_of(counts)
    schema = pa.schema([("n", pa.int64()), ("distinct", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary()), ("by_class", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, count, ending = _concat(iter([batch]), _COUNT_TYPES)
            group = ending_class(ending)
            sums = np.concatenate([np.bincount(group, weights=count, minlength=CLASSES), np.bincount(group, minlength=CLASSES)]).astype(np.int64)
            top = np.lexsort((word, -count))[:most]
            yield record(schema, [int(count.sum())], [len(word)], [word[top].tobytes()], [count[top].tobytes()], [ending[top].tobytes()], [sums.tobytes()])

    sent = counts.mapInArrow(task, "n long, distinct long, words binary, counts binary, endings binary, by_class binary")
    word, count, ending = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = distinct = 0
    sums = np.zeros(2 * CLASSES, np.int64)
    for r in sent.collect():  # about 2 * FREQUENT words in all
        n, distinct = n + r.n, distinct + r.distinct
        sums += np.frombuffer(r.by_class, np.int64)
        word = np.concatenate([word, np.frombuffer(r.words, U64)])
        count = np.concatenate([count, np.frombuffer(r.counts, np.int64)])
        ending = np.concatenate([ending, np.frombuffer(r.endings, np.int64)])
    top = np.lexsort((word, -count))[:FREQUENT]
    word, count, ending = word[top], count[top], ending[top]
    # Words with a slot of their own leave their ending's class.
    own = np.lexsort((word, -count))[: MEMBERS * FREQUENT_CLASSES]
    group = ending_class(ending[own])
    left = sums[:CLASSES] - np.bincount(group, weights=count[own], minlength=CLASSES).astype(np.int64)
    kinds = sums[CLASSES:] - np.bincount(group, minlength=CLASSES)
    return Totals(n, distinct, word, count, left, kinds)


def buckets_of(n: int) -> int:
    """Rows of hashed features for ``n`` training tokens."""
    return BUCKETS + int(GROWTH * n ** (1 / 3))


# --- the model ------------------------------------------------------------------------------------------------------------------


class Model:
    """Weights: (feature rows, classes), and (class before, slot) for frequent words."""

    def __init__(self, weights: np.ndarray, inner: np.ndarray, slots: int) -> None:
        self.weights, self.inner, self.slots = weights, inner, slots
        self.buckets = len(weights) - 1
        self._inner_log: np.ndarray | None = None

    def features(self, tokens: np.ndarray, classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the weights, class before) of every token of a block."""
        n = len(tokens)
        first = np.repeat(at[:-1], np.diff(at))
        place = np.arange(n)
        back = [np.where(place - k >= first, tokens[np.maximum(place - k, 0)], START) for k in (1, 2, 3)]
        before = np.where(place > first, classes[np.maximum(place - 1, 0)], CLASSES)
        mixed = (back[0], back[1] * U64(3) + U64(1), back[0] * U64(5) + back[1] * U64(7) + U64(2), back[2] * U64(11) + back[0] + U64(3), before.astype(U64) * U64(13) + U64(4))
        rows = np.stack([(mix(x) % U64(self.buckets)).astype(np.int64) for x in mixed], 1)
        return rows, before

    def class_scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of all classes, (tokens, classes); the last row of the weights is the bias."""
        out = np.empty((len(rows), CLASSES), self.weights.dtype)
        more = np.empty((min(LANES, len(rows)), CLASSES), self.weights.dtype)
        for low in range(0, len(rows), LANES):
            part, some = rows[low : low + LANES], out[low : low + LANES]
            # Rows are below the table's length, so clipping changes nothing; it spares a check and a copy.
            np.take(self.weights, part[:, 0], axis=0, out=some, mode="clip")
            some += self.weights[self.buckets]
            for k in range(1, FEATURES):
                some += np.take(self.weights, part[:, k], axis=0, out=more[: len(part)], mode="clip")
        return out

    def inner_log(self) -> np.ndarray:
        """log P(slot | its class, class before) as a table (classes + 1, slots)."""
        if self._inner_log is None:
            out = np.zeros_like(self.inner, dtype=np.float64)
            for low in range(0, self.slots, MEMBERS):
                part = self.inner[:, low : low + MEMBERS].astype(np.float64)
                top = part.max(1, keepdims=True)
                out[:, low : low + MEMBERS] = part - top - np.log(np.exp(part - top).sum(1, keepdims=True))
            self._inner_log = out
        return self._inner_log

    def log_probability(self, tokens: np.ndarray, slot: np.ndarray, classes: np.ndarray, rare: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability; ``rare`` is that of a token without a slot in its class."""
        rows, before = self.features(tokens, classes, at)
        out = np.empty(len(tokens))
        for low in range(0, len(tokens), LANES):
            cut = slice(low, low + LANES)
            s = self.class_scores(rows[cut])
            s -= s.max(1, keepdims=True)
            own = s[np.arange(len(s)), classes[cut]]
            out[cut] = own - np.log(np.exp(s, out=s).sum(1))
        own = slot >= 0
        out[own] += self.inner_log()[before[own], slot[own]]
        out[~own] += rare[~own]
        return out


def classes_of(slot: np.ndarray, ending: np.ndarray) -> np.ndarray:
    return np.where(slot >= 0, slot // MEMBERS, ending_class(ending))


def first_model(totals: Totals) -> Model:
    """Every class at its share of the counts, every frequent word at its share of its class."""
    share = totals.class_counts.astype(float) + ALPHA * (totals.class_words + 1)
    counts = np.zeros(totals.slots)
    own = totals.slot >= 0
    counts[totals.slot[own]] = totals.counts[own]
    per_class = np.bincount(np.arange(totals.slots) // MEMBERS, weights=counts, minlength=FREQUENT_CLASSES)[:FREQUENT_CLASSES] if totals.slots else np.zeros(FREQUENT_CLASSES)
    share[:FREQUENT_CLASSES] = np.where(per_class > 0, per_class, 1e-12)
    weights = np.zeros((buckets_of(totals.n) + 1, CLASSES), np.float32)
    weights[-1] = np.log(share / share.sum())
    inner = np.tile(np.log(np.maximum(counts, 1e-9)), (CLASSES + 1, 1)).astype(np.float32)
    return Model(weights, inner, totals.slots)


def _softmax(s: np.ndarray) -> np.ndarray:
    p = s - s.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def _sums_by_row(flat: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the gradients of each); position k of ``flat`` has the gradient ``k % len(g)``."""
    order = np.argsort(flat.astype(np.min_scalar_type(int(flat.max()))), kind="stable")
    name, at = flat[order], order % len(g)
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(first, len(name)))
    out = g.take(at[first], axis=0)
    # Short runs are added place by place for all rows at once, long ones singly.
    for k in range(1, 8):
        some = np.flatnonzero((size > k) & (size <= 8))
        out[some] += g.take(at[first[some] + k], axis=0)
    for k in np.flatnonzero(size > 8):
        out[k] = g.take(at[first[k] : first[k] + size[k]], axis=0).sum(0)
    return name[first], out


def update(model: Model, tokens: np.ndarray, slot: np.ndarray, classes: np.ndarray, at: np.ndarray, rate: float, seen: np.ndarray, seen_inner: np.ndarray) -> None:
    """Adaptive gradient steps over small runs of tokens; ``seen`` holds the squared gradients so far."""
    rows, before = model.features(tokens, classes, at)
    for low in range(0, len(tokens), PASS_TOKENS):
        cut = slice(low, low + PASS_TOKENS)
        r, c = rows[cut], classes[cut]
        g = _softmax(model.class_scores(r))
        g[np.arange(len(c)), c] -= 1
        name, grad = _sums_by_row(r.T.ravel(), g)
        name, grad = np.append(name, model.buckets), np.concatenate([grad, g.sum(0, keepdims=True)])
        seen[name] += grad * grad
        model.weights[name] -= rate * grad / np.sqrt(seen[name] + 1)
        own = np.flatnonzero(slot[cut] >= 0)
        if len(own):
            s, b = slot[cut][own], before[cut][own]
            lane = (s // MEMBERS * MEMBERS)[:, None] + np.arange(MEMBERS)[None, :]
            inside = lane < model.slots
            lane = np.minimum(lane, model.slots - 1)
            scores = np.where(inside, model.inner[b[:, None], lane], -np.inf)
            p = np.where(inside, _softmax(scores), 0)
            p[np.arange(len(s)), s % MEMBERS] -= 1
            flat = (b[:, None] * model.slots + lane).ravel()
            total = np.bincount(flat, weights=p.ravel(), minlength=model.inner.size).reshape(model.inner.shape).astype(np.float32)
            seen_inner += total * total
            model.inner -= rate * total / np.sqrt(seen_inner + 1)
    model._inner_log = None


def train(docs: DataFrame, totals: Totals) -> Model:
    """Rounds of gradient updates in all tasks from common weights; their changes are averaged by number of tokens."""
    model = first_model(totals)
    if not totals.n:
        return model
    rows = docs.filter(~held_out())
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    spark = docs.sparkSession
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.weights, model.inner))
        rate = RATE / (1 + number)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, inner = sent.value  # noqa: B023
            own = Model(weights.copy(), inner.copy(), totals.slots)
            seen, seen_inner = np.zeros_like(weights), np.zeros_like(inner)
            count = 0
            for _, data, offsets in text_blocks(batches, 1 << 18):
                tokens, ending, at = token_stream(data, offsets)
                _, slot = totals.lookup(tokens)
                update(own, tokens, slot, classes_of(slot, ending), at, rate, seen, seen_inner)  # noqa: B023
                count += len(tokens)
            if count:
                # Changes are weighed by how much a task has learned about each weight.
                for name, before, now, s in (("w", weights, own.weights, seen), ("i", inner, own.inner, seen_inner)):
                    weigh = np.sqrt(s)
                    yield from array_rows(name, ((now - before) * weigh).ravel().astype(np.float32), 1 << 15)
                    yield from array_rows(f"{name}n", weigh.ravel().astype(np.float32), 1 << 15)

        part = rows.filter(turn == number).select("text")
        summed = {k: np.zeros(x.size, np.float32) for k, x in (("w", model.weights), ("wn", model.weights), ("i", model.inner), ("in", model.inner))}
        for r in sum_arrays(part.mapInArrow(task, ARRAY_ROWS), np.float32).collect():  # as many numbers as the model has
            x = np.frombuffer(r["data"], np.float32)
            summed[r["key"]][r["at"] : r["at"] + len(x)] = x
        model = Model(
            model.weights + (summed["w"] / np.maximum(summed["wn"], 1e-9)).reshape(model.weights.shape),
            model.inner + (summed["i"] / np.maximum(summed["in"], 1e-9)).reshape(model.inner.shape),
            totals.slots,
        )
        sent.unpersist()
    return model


# --- scoring --------------------------------------------------------------------------------------------------------------------

_ASK_SQL = "kind int, part int, doc long, key long, words binary, times binary, docs binary, sums binary"
_ASK = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("words", pa.binary()), ("times", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary())])
_ROW, _ASKED = 0, 1


def _score_task(parts: int, totals, model):
    """Per document row: what frequent words and the model give; words outside the broadcast counts are asked for by hash range."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m = totals.value, model.value
        held, size = [], 0

        def send():
            word, times, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (word % U64(parts)).astype(np.int64)
            for p, a, b, c in deal(part, parts, word, times, owner):
                yield record(_ASK, [_ASKED], [p], [None], [None], [a], [b], [c], [None])

        for rows, data, offsets in text_blocks(batches):
            tokens, ending, at = token_stream(data, offsets)
            count, slot = t.lookup(tokens)
            classes = classes_of(slot, ending)
            known = count >= 0
            inside = t.class_counts[classes] + ALPHA * (t.class_words[classes] + 1)
            rare = np.where(known, np.log((np.maximum(count, 0) + ALPHA) / np.maximum(inside, 1e-300)), -np.log(np.maximum(inside, 1e-300)))
            value = m.log_probability(tokens, slot, classes, rare, at)
            base = np.where(known, np.log10(np.maximum(count, 0) + ALPHA), 0.0)
            first = at[:-1]
            n = np.diff(at)
            sums = np.stack([np.add.reduceat(base, first), np.add.reduceat(value, first) / np.log(10), np.add.reduceat(known & (count > 0), first, dtype=float), n.astype(float)], 1)
            keys = rows.column("key").to_numpy()
            blank = pa.nulls(len(n), pa.binary())
            yield record(_ASK, np.full(len(n), _ROW, np.int32), pa.nulls(len(n), pa.int32()), rows.column("doc_id"), keys, blank, blank, blank, pa.array([s.tobytes() for s in sums], pa.binary()))
            # The rest: one (document, word, times) triple for each distinct word.
            row = np.repeat(np.arange(len(n)), n)[~known]
            word = tokens[~known]
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            if len(word):
                lead = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])]))
                held.append((word[lead], np.diff(np.append(lead, len(word))).astype(np.int32), keys[row[lead]]))
                size += len(lead)
            if size > GATHERED:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    return task


_BACK_SQL = "part int, keys binary, logs binary, found binary"
_BACK = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary()), ("found", pa.binary())])
_BACK_TYPES = {"keys": np.int64, "logs": np.float64, "found": np.int64}
_SUM = pa.schema([("key", pa.int64()), ("logs", pa.float64()), ("found", pa.int64())])


def _sum_by_key(keys: np.ndarray, logs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    name, inverse = np.unique(keys, return_inverse=True)
    n = len(name)
    return name, np.bincount(inverse, weights=logs, minlength=n), np.bincount(inverse, weights=found, minlength=n).astype(np.int64)


def _add_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, logs, found = _sum_by_key(*_concat(batches, _BACK_TYPES))
    for k in range(0, len(name), 10_000):
        yield record(_SUM, name[k : k + 10_000], logs[k : k + 10_000], found[k : k + 10_000])


def _answer_words(parts: int):
    """Of one hash range: the counts' row and the questions; per document the sum of log10(count + 0.1) and the known tokens,
    packed for the parts of the exchange in which the documents' sums are added."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = list(_answers(batches))
        if sums:
            name, logs, found = _sum_by_key(*(np.concatenate(x) for x in zip(*sums, strict=True)))
            for p, a, b, c in deal((mix(name.view(U64)) % U64(parts)).astype(np.int64), parts, name, logs, found):
                yield record(_BACK, [p], [a], [b], [c])

    return task


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    asked: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for row in range(batch.num_rows):
            get = lambda c, t: np.frombuffer(batch.column(c)[row].as_py(), t)  # noqa: B023, E731
            if kinds[row] == _ROW:
                words, counts = np.concatenate([words, get("words", U64)]), np.concatenate([counts, get("times", np.int64)])
            else:
                asked.append((get("words", U64), get("times", np.int32), get("docs", np.int64)))
    if not asked:
        return
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    for low in range(0, len(asked), 64):
        word, times, doc = (np.concatenate(x) for x in zip(*asked[low : low + 64], strict=True))
        at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
        c = np.where(words[at] == word, counts[at], 0) if len(words) else np.zeros(len(word), np.int64)
        yield _sum_by_key(doc, np.log10(c + ALPHA) * times, (c > 0) * times)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_of(docs)
    counts = training_counts(source)
    totals = totals_of(counts)
    model = train(source, totals)
    context = docs.sparkSession.sparkContext
    # Rows repeated whole have one key and one answer; a row's key is that of its id and text.
    keyed = source.withColumn("key", F.xxhash64("doc_id", "text"))
    asked = cut_lineage(keyed.mapInArrow(_score_task(parts, context.broadcast(totals), context.broadcast(model)), _ASK_SQL))
    rows = asked.filter(F.col("kind") == _ROW).select("doc", "key", "sums")
    questions = asked.filter(F.col("kind") == _ASKED).select("kind", "part", "words", "times", "docs")
    known = counts.select(F.lit(_ROW).alias("kind"), "part", "words", F.col("counts").alias("times"), F.lit(None).cast("binary").alias("docs"))
    both = known.unionByName(questions).repartitionById(parts, F.col("part"))
    packed = both.mapInArrow(_answer_words(parts), _BACK_SQL).repartitionById(parts, F.col("part"))
    back = packed.mapInArrow(_add_answers, "key long, logs double, found long")
    # A key's sums are of all its rows; rows with one key are equal, so each takes its share.
    times = rows.groupBy("key").agg(F.count("*").alias("times"))
    shared = back.join(times, "key").select("key", (F.col("logs") / F.col("times")).alias("logs"), (F.col("found") / F.col("times")).alias("found"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("seen", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            x = np.frombuffer(string_buffer(batch.column("sums"))[0].tobytes(), np.float64).reshape(-1, 4)
            yield record(schema, batch.column("doc"), batch.column("key"), x[:, 0], x[:, 1], x[:, 2].astype(np.int64), x[:, 3].astype(np.int64))

    plain = rows.mapInArrow(unpack, "doc_id long, key long, base double, model double, seen long, n_tokens long")
    joined = plain.join(shared, "key", "left")
    logs, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("found", F.lit(0.0))
    norm = float(np.log10(totals.n + ALPHA * (totals.distinct + 1)))
    return joined.select(
        "doc_id",
        held_out(),
        "n_tokens",
        (F.col("seen") + F.round(found)).cast("long").alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )

