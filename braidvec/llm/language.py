"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed n-grams by language in every task and adds the counts by ranges of the table, so the shuffle carries
``languages * buckets`` numbers a task at most. The log-probability matrix has a size fixed by ``buckets`` and the number of
languages (checked); it is broadcast, and texts are scored in blocks by sparse sums over its rows.

Defined results: a null text or one without a letter is ``und`` with score 0. With nothing to learn from, every text is ``und``.
Equal probabilities go to the language that comes first in code-point order. Repeated rows count, and are answered, as often as
they occur. Very long texts are scored whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ARRAY_ROWS, BLOCK_BYTES, array_rows, record, remainder, sum_arrays

UNKNOWN = "und"
BITS = 15  # buckets of the hashed n-grams: 2**15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# Largest log-probability matrix that is broadcast, in numbers (4 bytes each).
MATRIX_CELLS = 1 << 26
_SPLIT = 64  # ranges of buckets in which counts are added


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_buckets(codes: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """Bucket of the n-gram that ends at every position from ``order - 1`` on."""
    h = np.full(len(codes) - order + 1, 0x9E3779B9 + order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint32(0x01000193) + np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def _pieces(texts: list[str], limit: int = BLOCK_BYTES // 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of every code point, code points) of lower-cased texts, in pieces. Every text begins with a blank.

    A long text goes on in the next piece, which repeats its last code points so that no n-gram is lost or counted twice.
    """
    rows, codes, size = [], [], 0
    for k, text in enumerate(texts):
        c = np.frombuffer((" " + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
        for low in range(0, len(c), limit):
            part = c[max(0, low - max(ORDERS) + 1) : low + limit]
            codes.append(part)
            rows.append((k, len(part), min(low, max(ORDERS) - 1)))
            size += len(part)
            if size >= limit:
                yield rows, np.concatenate(codes)
                rows, codes, size = [], [], 0
    if codes:
        yield rows, np.concatenate(codes)


def _features(rows: list[tuple[int, int, int]], codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of every n-gram, bucket) for each order; n-grams lie within one text and are new in their piece."""
    owner = np.repeat([r[0] for r in rows], [r[1] for r in rows]).astype(np.int64)
    inside = np.concatenate([np.arange(n) for _, n, _ in rows])
    repeated = np.repeat([r[2] for r in rows], [r[1] for r in rows])
    for order in ORDERS:
        if len(codes) >= order:
            new = inside[order - 1 :] >= np.maximum(order - 1, repeated[order - 1 :])
            yield owner[order - 1 :][new], ngram_buckets(codes, order, bits)[new]


class LanguageModel:
    """Languages in order and the matrix log P(bucket | language) with one column a language, plus log priors."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, bits: int) -> None:
        self.langs, self.logp, self.prior, self.bits = langs, logp, prior, bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.langs else []
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known:
            return lang, score
        total = np.tile(self.prior.astype(float), (len(known), 1))
        for rows, codes in _pieces([texts[k] for k in known]):
            for owner, bucket in _features(rows, codes, self.bits):
                cut = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(cut):
                    total[owner[cut]] += np.add.reduceat(self.logp[bucket], cut, axis=0, dtype=np.float64)
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p = p[np.arange(len(known)), best] / p.sum(1)
        for k, b, x in zip(known, best, p, strict=True):
            lang[k], score[k] = self.langs[b], min(1.0, float(x))
        return lang, score


def learn_languages(docs: DataFrame, bits: int = BITS) -> LanguageModel:
    """Count the n-grams of every row of (text, lang) with neither missing; counts are added in the executors."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
    size = 1 << bits
    step = max(1, size // _SPLIT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in table.items():
                yield from array_rows(lang, total, size // _SPLIT)
            table.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                total = table.setdefault(lang, np.zeros(size + size // _SPLIT, np.int64))
                total[size] += len(own)  # after the buckets: the number of texts
                for piece in _pieces(own):
                    for _, bucket in _features(*piece, bits):
                        total[:size] += np.bincount(bucket, minlength=size)
            if len(table) * size * 8 > 1 << 28:
                yield from flush()
        yield from flush()

    step, most = size // _SPLIT, MATRIX_CELLS // (size // _SPLIT)
    found = sum_arrays(rows.mapInArrow(count, ARRAY_ROWS), np.int64).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {MATRIX_CELLS} numbers are too many to broadcast; lower bits")
    langs = sorted({r["key"] for r in found})
    counts = np.zeros((size + step, len(langs)))
    for r in found:
        counts[r["at"] : r["at"] + step, langs.index(r["key"])] = np.frombuffer(r["data"], np.int64)
    docs_of, counts = counts[size], counts[:size]
    logp = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * size)
    return LanguageModel(langs, logp.astype(np.float32), np.log(docs_of / docs_of.sum()) if langs else docs_of, bits)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = sent.value.predict(batch.column("text").to_pylist())
            yield record(schema, batch.column("doc_id"), lang, score)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32(doc_id as text) is not 2 modulo 4."""
    return docs.filter(remainder("doc_id", 4) != 2)


def held_out() -> Column:
    return (remainder("doc_id", 4) == 2).alias("held_out")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training rows and answer for all: doc_id, held_out, lang_pred, score."""
    model = learn_languages(training_rows(docs))
    return predict_languages(docs, model).select("doc_id", held_out(), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Rows whose language is known with at least ``least`` probability; all columns stay as they are. A model that has learned
    no language rejects only texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = sent.value.predict(batch.column(at).to_pylist())
            if sent.value.langs:
                keep = np.array([x != UNKNOWN for x in lang], bool) & (score >= least)
            else:
                keep = np.array([has_letter(t) for t in batch.column(at).to_pylist()], bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(task, docs.schema)

