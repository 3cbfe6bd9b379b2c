"""Token counts kept up to date by signed deltas.

A batch of changes becomes rows with a sign: an insert adds a document's counts, a delete takes them away, a revision does both.
Rows are pre-aggregated by (source, lang, tokenizer version) and written to the batch's own folder in one overwrite; a folder
counts once Spark has finished it. Committing a batch again replaces it by itself, so a repeated or restarted commit changes
nothing, and a lost executor costs only its tasks. Totals are the sum of all batches: additive, in any order. ``compact`` folds
many batches into one; the new folder remembers their numbers, so that an old batch that comes again is left out.

Defined results: null source, lang or version is a group of its own. A null text has no tokens but is a document. Repeated rows
of one change count as often as they occur. Totals that fall to no documents and no tokens are left out. An empty batch is valid, and a store without a batch has no totals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import record

KEYS = ("source", "lang", "version")
MEASURES = ("n_docs", "n_tokens", "n_bytes")
DELTA_COLUMNS = (*KEYS, *MEASURES)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-pair vocabulary's own tokenizer splits text before merging (a fixed value of that vocabulary).
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = 1 << 16  # characters that are tokenized at once


@lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ledger(docs: DataFrame, versions: dict[str, str | None]) -> DataFrame:
    """doc_id, source, lang, digest of the text, n_bytes and one column of counts a version, of every row; one pass.

    A version names a vocabulary file, which must lie at the same path on every executor; None counts white-space words.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plain = [words.alias(v) for v, path in versions.items() if path is None]
    files = {v: path for v, path in versions.items() if path is not None}
    rows = base.select("doc_id", "source", "lang", digest, n_bytes, *plain, "text")
    if not files:
        return rows.drop("text")
    keep = rows.columns[:-1]
    types = dict(rows.dtypes)
    schema = pa.schema([(c, pa.string() if types[c] == "string" else pa.int64()) for c in keep] + [(v, pa.int64()) for v in files])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = [[sum(len(_encoding(path).encode_ordinary(p)) for p in pieces(t or "")) for t in texts] for path in files.values()]
            yield record(schema, *batch.columns[: len(keep)], *counts)

    return rows.mapInArrow(task, ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in schema.names))


def counts_of(ledger: DataFrame, version: str) -> DataFrame:
    """doc_id, source, lang, version, n_tokens, n_bytes of one version."""
    return ledger.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.col(f"`{version}`").alias("n_tokens"), "n_bytes")


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """A text in pieces cut before a blank that follows a letter, where the split pattern cuts in any case; a text without such
    a place stays whole."""
    low = 0
    while len(text) - low > size:
        cut = low + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut += 1
        yield text[low:cut]
        low = cut
    yield text[low:]


def signed(counts: DataFrame, sign: int | Column) -> DataFrame:
    """Deltas of counted documents: +1 for inserts, -1 for deletes."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    s = s.cast("long")
    return counts.select(*KEYS, s.alias("n_docs"), (F.col("n_tokens") * s).alias("n_tokens"), (F.col("n_bytes") * s).alias("n_bytes"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that replace the counts of ``before`` by those of ``after``, also under another version, source or language."""
    return signed(before, -1).unionByName(signed(after, 1))


class Rollups:
    """Totals below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch: int, deltas: DataFrame) -> None:
        """Add a batch; the same number again replaces what it added before, and changes nothing once it was folded."""
        if self._read("folded", "batch long").filter(F.col("batch") == int(batch)).limit(1).count():
            return
        rows = deltas.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={int(batch):012d}")

    def _read(self, below: str, columns: str) -> DataFrame:
        """Rows below the folder, none if nothing was written there."""
        try:
            return self.spark.read.option("basePath", self.folder).schema(columns).parquet(f"{self.folder}/{below}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], columns)

    def _batches(self) -> DataFrame:
        return self._read("batch=*", ", ".join([*(f"{k} string" for k in KEYS), *(f"{m} long" for m in MEASURES), "batch long"]))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_bytes over all batches."""
        rows = self._batches().groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        return rows.filter(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self, batch: int, to: str) -> Rollups:
        """Totals so far as one batch of a new folder, which knows the batches that were folded into it."""
        out = Rollups(self.spark, to)
        out.commit(batch, self.totals())
        folded = self._batches().select("batch").unionByName(self._read("folded", "batch long")).filter(F.col("batch") != int(batch)).distinct()
        folded.write.mode("overwrite").parquet(f"{out.folder}/folded")
        return out
