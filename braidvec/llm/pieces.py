"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text becomes the model's normal form (a leading blank, blanks written as U+2581) and falls into words at blanks and at
characters that no longer piece contains; no piece crosses such a place, so each word is segmented by itself, once for all its
occurrences in a block of texts. Words of equal length advance together: at every position the hashes of all substrings that end
there probe the sorted hashes of the pieces, and one maximum over the candidates gives scores and backpointers of all words.

The segmentation maximises the sum of the pieces' scores; among equal sums the longer last piece wins. A model of the BPE kind
holds merge ranks, which are turned into log-probabilities first; its segmentation is then that of a unigram model with its
pieces, so ids may differ from those that merging gives, while decoding gives the text back in either case. A character without
a piece becomes its UTF-8 bytes when the model has byte pieces, else the unknown id.

Defined results: null encodes as null, the empty text as no pieces. Every text without U+2581 round-trips exactly if the model has
byte pieces. Memory is bounded by blocks of characters and one text's ids; words of any length work, in groups of bounded size.
The model file must lie at the same path on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .text import U64, mix, prefix_sums, range_hash, record

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
BLOCK_CHARS = 1 << 19  # characters whose distinct words are found together
GROUP_CELLS = 1 << 21  # (word, start) candidates that are compared at once
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_BPE_MODEL = 2


MEMORY_WORDS = 1 << 19  # segmented words that a task remembers; beyond that it begins anew


def _nothing_seen() -> tuple[np.ndarray, ...]:
    return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)


class PieceModel:
    """Pieces of a model file in tables for numpy."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave text as it is can be decoded to the same text")
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        # BPE models hold the ranks of merges in place of log-probabilities; by Zipf's law, a piece of rank r has one of 1 / r.
        ranks = proto.trainer_spec.model_type == _BPE_MODEL
        zipf = np.log(sum(1 / r for r in range(1, len(proto.pieces) + 1)))
        usable = [(k, p.piece, -float(np.log(1 - p.score) + zipf) if ranks else p.score) for k, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)]
        self.unknown = next((k for k, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
        self.byte_ids = np.full(256, -1, np.int32)
        for k, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
        self.has_bytes = bool((self.byte_ids >= 0).all())
        self.longest = max(len(s) for _, s, _ in usable)
        codes = np.frombuffer("".join(s for _, s, _ in usable).encode("utf-32-le"), np.uint32)
        size = np.array([len(s) for _, s, _ in usable])
        end = np.cumsum(size)
        keys = range_hash(prefix_sums(mix(codes)), end - size, end)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([k for k, _, _ in usable], np.int32)[order]
        self.scores = np.array([x for _, _, x in usable])[order]
        assert (np.diff(self.keys.astype(object)) > 0).all(), "two pieces have one hash"
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(keys >> U64(42)).astype(np.int64)] = True
        #: Characters that occur in pieces of two or more characters other than runs of blanks.
        inner = np.unique(np.frombuffer("".join(s for _, s, _ in usable if len(s) > 1 and set(s) != {chr(BLANK)}).encode("utf-32-le"), np.uint32))
        self.joins = np.zeros(0x110001, bool)
        self.joins[inner] = True
        #: Bytes that each id stands for.
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else p.piece.replace(chr(BLANK), " ").encode() for p in proto.pieces]
        if self.unknown < len(self.bytes):
            self.bytes[self.unknown] = " ⁇ ".encode()
        self.byte_size = np.array([len(b) for b in self.bytes])
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.seen = _nothing_seen()

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the piece or -1, score or -inf) for hashes of substrings."""
        out = np.full(keys.shape, -1, np.int64)
        flat, found = keys.reshape(-1), out.reshape(-1)
        maybe = np.flatnonzero(self.filter[(flat >> U64(42)).astype(np.int64)])
        at = np.searchsorted(self.keys, flat[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == flat[maybe]
        found[maybe[hit]] = at[hit]
        return out, np.where(out >= 0, self.scores[out], -np.inf)

    def segment(self, codes: np.ndarray, start: np.ndarray, size: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length: lengths of the chosen last pieces and their index (-1: a character without a
        piece), both (words, size + 1)."""
        n = len(start)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int64)
        for end in range(1, size + 1):
            # From the longest piece to the shortest: the first maximum is the longest.
            lengths = np.arange(min(end, self.longest), 0, -1)
            stop = np.broadcast_to((start + end)[:, None], (n, len(lengths)))
            index, score = self.probe(range_hash(sums, stop - lengths, stop))
            total = best[:, end - lengths] + score
            # A single character without a piece is worse than any piece; all ways through it pay for it alike.
            lone = index[:, -1] < 0
            total[lone, -1] = best[lone, end - 1] - 1e12
            pick = total.argmax(1)
            rows = np.arange(n)
            best[:, end], back[:, end], piece[:, end] = total[rows, pick], lengths[pick], index[rows, pick]
        return back, piece

    def encode_words(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their counts)."""
        sums = prefix_sums(mix(codes))
        counts = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, order within the word, id
        for length in np.unique(size):
            group = np.flatnonzero(size == length)
            step = max(1, GROUP_CELLS // (int(length) + 1) // self.longest)
            for low in range(0, len(group), step):
                words = group[low : low + step]
                back, piece = self.segment(codes, start[words], int(length), sums)
                at = np.full(len(words), int(length))
                live = np.arange(len(words))
                place = 0
                while len(live):
                    index, step_back = piece[live, at[live]], back[live, at[live]]
                    known = index >= 0
                    ids = np.where(known, self.ids[index], self.unknown)
                    if self.has_bytes and not known.all():
                        for row in np.flatnonzero(~known):  # rare: the bytes of one character, last first
                            raw = chr(codes[start[words[live[row]]] + at[live[row]] - 1]).encode("utf-8", "surrogatepass")
                            for k, b in enumerate(reversed(raw)):
                                parts.append((words[live[row : row + 1]], np.array([-place * 4 - k]), self.byte_ids[b : b + 1]))
                        parts.append((words[live[known]], np.full(int(known.sum()), -place * 4), ids[known]))
                    else:
                        parts.append((words[live], np.full(len(live), -place * 4), ids))
                    at[live] -= step_back
                    live = live[at[live] > 0]
                    place += 1
        if not parts:
            return np.zeros(0, np.int32), counts
        word, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, word))
        counts += np.bincount(word, minlength=len(start))
        return ids[order].astype(np.int32), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, counts)."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for owner, codes in _pieces(texts, self.dummy):
            owner_starts = np.concatenate([[True], owner[1:] != owner[:-1]])
            joins = self.joins[codes]
            blank = codes == BLANK
            cut = owner_starts | blank | ~joins
            cut[1:] |= ~joins[:-1]
            cut[1:] &= owner_starts[1:] | ~(blank[1:] & blank[:-1])  # a run of blanks stays with the word after it
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(codes))
            keys = range_hash(prefix_sums(mix(codes)), start, end)
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            word_ids, at, n = self._known_words(codes, start[first], (end - start)[first], keys[first])
            each = n[inverse]
            shift = np.repeat(at[inverse] - (np.cumsum(each) - each), each)
            ids.append(word_ids[shift + np.arange(int(each.sum()))])
            counts += np.bincount(owner[start], weights=each, minlength=len(texts)).astype(np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts

    def _known_words(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place and count of each word) with the words of earlier blocks remembered; ``keys`` are sorted."""
        if len(self.seen[0]) > MEMORY_WORDS:
            self.seen = _nothing_seen()
        old, place, count, ids = self.seen
        at = np.minimum(np.searchsorted(old, keys), max(0, len(old) - 1))
        new = np.flatnonzero(old[at] != keys) if len(old) else np.arange(len(keys))
        if len(new):
            more, n = self.encode_words(codes, start[new], size[new])
            merged = np.concatenate([old, keys[new]])
            order = np.argsort(merged, kind="stable")
            place = np.concatenate([place, len(ids) + np.cumsum(n) - n])[order]
            count = np.concatenate([count, n])[order]
            old, ids = merged[order], np.concatenate([ids, more])
            self.seen = old, place, count, ids
            at = np.searchsorted(old, keys)
        return ids, place[at], count[at]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids; the blank that encoding put in front is taken away."""
        size = self.byte_size[ids]
        at = np.cumsum(size) - size
        data = self.byte_data[np.repeat(self.byte_start[ids] - at, size) + np.arange(int(size.sum()))].tobytes()
        cut = np.concatenate([[0], np.cumsum(counts)])
        edge = np.append(at, len(data))[cut]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return [t[1:] if self.dummy and t.startswith(" ") else t for t in out]


def _pieces(texts: list[str], dummy: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of every character, characters in normal form) of blocks; a long text is cut before a blank."""
    held, owners, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text = " " + text if dummy else text
        low = 0
        while low < len(text):
            high = low + BLOCK_CHARS
            if high < len(text):
                high = text.find(" ", high)
                high = len(text) if high < 0 else high
            codes = np.frombuffer(text[low:high].encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            codes[codes == 0x20] = BLANK
            held.append(codes)
            owners.append(np.full(len(codes), k))
            size += len(codes)
            low = high
            if size >= BLOCK_CHARS:
                yield np.concatenate(owners), np.concatenate(held)
                held, owners, size = [], [], 0
    if size:
        yield np.concatenate(owners), np.concatenate(held)


@lru_cache(maxsize=2)
def piece_model(path: str = MODEL) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_pieces, ids: array<int>, and whether decoding gives the text back, of every row; one pass."""
    schema = docs.select(*keep).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = part.column(part.num_columns - 1).to_pylist()
                plain = [t or "" for t in texts]
                ids, counts = model.encode(plain)
                gone = np.array([t is None for t in texts])
                back = [a == b for a, b in zip(plain, model.decode(ids, counts), strict=True)]
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(gone, False))
                lists = pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))
                own = [pa.array(counts, pa.int64(), mask=gone), lists, pa.array(back, pa.bool_(), mask=gone)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], [*part.schema.names[:-1], "n_pieces", "ids", "round_trip"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(task, f"{names}, n_pieces long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` with ``text`` in place of ids."""
    names = [c for c in encoded.columns if c != "ids"]
    sql = "".join(f"`{c}` {t}, " for c, t in encoded.dtypes if c != "ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(len(names))
            counts = lists.value_lengths().fill_null(0).to_numpy()
            texts = model.decode(lists.flatten().to_numpy(), counts)
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string(), mask=gone)], [*names, "text"])

    return encoded.select(*names, "ids").mapInArrow(task, f"{sql}text string")


def piece_report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, digest of the ids (little-endian 32-bit), and whether decoding gives the text back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts = model.encode(texts)
                back = model.decode(ids, counts)
                cut = np.concatenate([[0], np.cumsum(counts)])
                digest = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield record(schema, part.column("doc_id"), counts, digest, [a == b for a, b in zip(texts, back, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")
