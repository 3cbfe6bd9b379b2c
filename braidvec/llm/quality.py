"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over overlapping chunks that cover the whole document. In each chunk every filter keeps its
largest response; a document keeps, for every filter, the largest and the mean of its chunks' responses, and a logistic layer
turns those into one probability. A filter is a table (position, byte) of weights, so a response is a sum of table rows; for
scoring, neighbouring positions are joined into byte-pair tables, which halves the look-ups and changes nothing else.

The network is fitted on at most ``SAMPLE_ROWS`` labelled documents a class, chosen by a hash of doc_id, in one task of the
cluster; of each it reads at most ``SAMPLE_BYTES``, in pieces spread evenly over the document. Scoring reads every byte.

Defined results: null and empty texts are scored as a chunk of padding. Labels that are null or other than 0 and 1, and rows
without a document, teach nothing; with no label, or only one class, the score is the smoothed share of that class. A document
labelled several times counts once, with its largest label. Repeated document rows are scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import record, remainder, text_blocks

WIDTH = 8  # bytes under a filter; even
FILTERS = 16
CHUNK, STRIDE, CELL = 256, 192, 64  # chunks of 256 windows, one every 192; maxima are first taken over cells of 64
SAMPLE_ROWS = 1500  # labelled documents of each class that are fitted
SAMPLE_BYTES = 8192  # of each of them
EPOCHS = 12
THRESHOLD = 0.3
_PIECES = 8


def held_out() -> Column:
    return (remainder("doc_id", 5) == 0).alias("held_out")


class Layout:
    """Where the windows and chunks of a block of documents lie. Every document is followed by ``WIDTH`` bytes of padding."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        cells = np.maximum(1, -(-sizes // CELL))
        # A document takes a whole number of cells, so that maxima over cells are one reshape.
        self.cell_at = np.concatenate([[0], np.cumsum(cells)])
        length = int(self.cell_at[-1]) * CELL
        self.bytes = np.zeros(length + WIDTH, np.uint8)
        place = np.arange(len(data)) + np.repeat(self.cell_at[:-1] * CELL - offsets[:-1], sizes)
        self.bytes[place] = data
        # Windows that begin past a document's last byte are padding; at least one window counts.
        self.windows = np.maximum(1, sizes)
        per = CHUNK // CELL
        step = STRIDE // CELL
        chunks = np.maximum(1, -(-(cells - per) // step) + 1)
        self.chunk_at = np.concatenate([[0], np.cumsum(chunks)])
        first = np.repeat(self.cell_at[:-1], chunks) + step * (np.arange(self.chunk_at[-1]) - np.repeat(self.chunk_at[:-1], chunks))
        last = np.repeat(self.cell_at[1:], chunks) - 1
        self.cells = np.minimum(first[:, None] + np.arange(per), last[:, None])  # cells of each chunk
        self.n = n

    def beyond(self) -> np.ndarray:
        """Windows that begin after their document's last byte."""
        at = np.arange(int(self.cell_at[-1]) * CELL)
        owner = np.repeat(np.arange(self.n), np.diff(self.cell_at) * CELL)
        return at - self.cell_at[owner] * CELL >= self.windows[owner]


def pool(layout: Layout, response: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 2 * filters): largest and mean over chunks of the chunk maxima; and the chunk maxima."""
    cell = response.reshape(-1, CELL, response.shape[1]).max(1)
    chunk = cell[layout.cells].max(1)
    starts = layout.chunk_at[:-1]
    top = np.maximum.reduceat(chunk, starts, axis=0)
    mean = np.add.reduceat(chunk, starts, axis=0) / np.diff(layout.chunk_at)[:, None]
    return np.concatenate([top, mean], 1), chunk


class ByteNet:
    """Weights of the filters, (WIDTH, 256, FILTERS), and of the logistic layer."""

    def __init__(self, filters: np.ndarray, dense: np.ndarray, bias: float, scale: np.ndarray, shift: np.ndarray) -> None:
        self.filters, self.dense, self.bias, self.scale, self.shift = filters.astype(np.float32), dense, bias, scale, shift
        self._pairs: np.ndarray | None = None

    def responses(self, layout: Layout) -> np.ndarray:
        """Filter responses of every window; windows past the end of a document are below all others."""
        if self._pairs is None:
            f = self.filters
            self._pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]
        b = layout.bytes.astype(np.int32)
        pair = (b[:-1] << 8) | b[1:]
        n = len(b) - WIDTH
        out = self._pairs[0].take(pair[:n], axis=0)
        for k in range(1, WIDTH // 2):
            out += self._pairs[k].take(pair[2 * k : 2 * k + n], axis=0)
        out[layout.beyond()] = -1e4
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        layout = Layout(data, offsets)
        features, _ = pool(layout, self.responses(layout))
        return _sigmoid(((features - self.shift) * self.scale) @ self.dense + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def spread(text: bytes, limit: int = SAMPLE_BYTES) -> bytes:
    """At most ``limit`` bytes of a text, in equal pieces spread over all of it."""
    if len(text) <= limit:
        return text
    size = limit // _PIECES
    return b"".join(text[a : a + size] for a in np.linspace(0, len(text) - size, _PIECES).astype(int))


def fit_net(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> ByteNet:
    """Adam on the logistic loss, classes weighed equally; gradients pass only through the windows that the pooling chose."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    flat = ByteNet(np.zeros((WIDTH, 256, FILTERS)), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))), np.ones(2 * FILTERS), np.zeros(2 * FILTERS))
    if len(texts) == 0 or labels.min() == labels.max():
        return flat
    order = np.arange(len(texts))
    params = [rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)]
    moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in params]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    net = ByteNet(params[0], params[1], 0.0, np.ones(2 * FILTERS), np.zeros(2 * FILTERS))
    size, t = 64, 0
    for epoch in range(epochs):
        rng.shuffle(order)
        for low in range(0, len(order), size):
            pick = order[low : low + size]
            joined = b"".join(texts[k] for k in pick)
            layout = Layout(np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum([len(texts[k]) for k in pick])]))
            f, n = params[0], len(layout.bytes) - WIDTH
            response = f[0].take(layout.bytes[:n], axis=0)
            for k in range(1, WIDTH):
                response += f[k].take(layout.bytes[k : k + n], axis=0)
            response[layout.beyond()] = -1e4
            features, chunk = pool(layout, response)
            error = (_sigmoid(features @ params[1] + params[2][0]) - labels[pick]) * weight[pick] / len(pick)
            # Where each chunk found its maximum: first the cell, then the window in it.
            cells = response.reshape(-1, CELL, FILTERS)
            cell_max, cell_arg = cells.max(1), cells.argmax(1)
            which = cell_max[layout.cells].argmax(1)
            cell = np.take_along_axis(layout.cells, which, 1)
            window = cell * CELL + cell_arg[cell, np.arange(FILTERS)]
            owner = np.repeat(np.arange(layout.n), np.diff(layout.chunk_at))
            g_doc = error[:, None] * params[1][None, :]
            g_chunk = (g_doc[:, FILTERS:] / np.diff(layout.chunk_at)[:, None])[owner]
            is_top = chunk == features[owner, :FILTERS]
            ties = np.add.reduceat(is_top, layout.chunk_at[:-1], axis=0, dtype=float)
            g_chunk = g_chunk + is_top * (g_doc[:, :FILTERS] / ties)[owner]
            g_filters = np.zeros_like(f, np.float64)
            column = np.broadcast_to(np.arange(FILTERS), window.shape)
            for k in range(WIDTH):
                np.add.at(g_filters[k], (layout.bytes[window + k], column), g_chunk)
            grads = [g_filters + 1e-5 * f, features.T @ error + 1e-4 * params[1], np.array([error.sum()])]
            t += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(p.dtype)
    net.filters, net.dense, net.bias = params[0].astype(np.float32), params[1], float(params[2][0])
    # Classes were weighed equally; move back to the shares that the labels have.
    net.bias += float(np.log(share / (1 - share)))
    return net


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality) of the rows to fit on: a bounded number of each class, chosen by a hash of doc_id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    of = lambda q: known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return of(0).unionByName(of(1))


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteNet:
    """Fit the network in one task on the bounded sample; the driver receives the weights only."""
    picked = F.broadcast(sample_labels(labels, rows))  # at most 2 * rows rows of two numbers
    clipped = F.udf(lambda t: spread((t or "").encode("utf-8", "replace")), "binary")  # bounded rows only, after the join
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", clipped("text").alias("text"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        net = fit_net(list(frame["text"]), frame["quality"].to_numpy(np.float64))
        return pd.DataFrame([(x.astype(np.float64).tobytes(),) for x in (net.filters, net.dense, np.array([net.bias]), net.scale, net.shift)], columns=["w"]).reset_index(names="k")

    # The group is bounded by 2 * rows documents of SAMPLE_BYTES.
    found = sample.groupBy(F.lit(1).alias("all")).applyInPandas(fit, "k long, w binary").orderBy("k").collect()
    if not found:
        return fit_net([], np.zeros(0))
    w = [np.frombuffer(r["w"]) for r in found]
    return ByteNet(w[0].reshape(WIDTH, 256, FILTERS), w[1], float(w[2][0]), w[3], w[4])


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of every row of (doc_id, text); one pass, no shuffle, memory bounded by blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, 1 << 18):
            yield record(schema, rows.column("doc_id"), sent.value.score(data, offsets))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

