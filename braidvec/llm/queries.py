"""Registered queries of the text and vector operators: each reads its whole table and returns its full result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from . import binpack, language, maxent, pieces, pii, quality, repair, rollups, sigtree, suffix, templates, topk, trie
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return topk.top_k(vectors, queries, 5)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_links(table(spark, sf_dir, "documents"))


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(table(spark, sf_dir, "documents"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


@query
def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, take back exact copies of earlier ones, and count the rest anew with a byte-pair tokenizer."""
    folder = f"{ensure_checkpoint_dir(spark)}/rollups-{uuid.uuid4().hex}"
    store = rollups.Rollups(spark, folder)
    versions = {"words-1": None, "byte_bpe_50k": rollups.VOCABULARY}
    ledger = cut_lineage(rollups.token_ledger(table(spark, sf_dir, "documents"), versions))  # a few numbers a document
    first = ledger.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    words = rollups.counts_of(ledger, "words-1")
    kept, copies = ledger.join(first, "doc_id", "left_semi"), words.join(first, "doc_id", "left_anti")
    store.commit(1, rollups.signed(words, 1))
    store.commit(2, rollups.signed(copies, -1))
    store.commit(3, rollups.revised(rollups.counts_of(kept, "words-1"), rollups.counts_of(kept, "byte_bpe_50k")))
    store.commit(2, rollups.signed(copies, -1))  # a repeated commit changes nothing
    return store.totals()


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(conversations), conversations.select("conv_id"))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_documents(table(spark, sf_dir, "documents"))


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return dict(QUERIES), dict(SQL)
