"""Codebooks: one hypervector per feature tuple, as tables that any task can regenerate from the seed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidvec.functions import vsa as V
from braidvec.functions.batch import to_engine, vector_rows
from braidvec.functions.features import feature_index, feature_tuple
from braidvec.functions.hashing import keyed_md5, unit_uniform
from braidvec.plans.skew import with_global_rank
from braidvec.session import BROADCAST_CELLS, BROADCAST_KEYS, cut_lineage


@dataclass(frozen=True)
class Codebook:
    """Table (idx, hv) with what is needed to judge its size. ``rows`` is an upper bound on its row count."""

    table: DataFrame
    bins: tuple[int, ...]
    dim: int
    vsa: str
    rows: int

    @property
    def fits(self) -> bool:
        """Whether the whole table may be sent to every task."""
        return self.rows * self.dim * (2 if V.is_complex(self.vsa) else 1) <= BROADCAST_CELLS

    def joinable(self) -> DataFrame:
        """The table, marked for broadcast when its size bound allows."""
        return F.broadcast(self.table) if self.fits else self.table

    def spectral(self) -> "Codebook":
        """HRR rows as spectra; other kinds unchanged."""
        if self.vsa != "HRR" or "struct" in self.table.schema["hv"].dataType.simpleString():
            return self
        return replace(self, table=self.table.withColumn("hv", V.to_spectral("hv")))

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted idx values and the rows in engine form (half spectra for HRR); size-checked."""
        if not self.fits:
            raise ValueError("codebook too large to send to every task")
        rows = self.table.select("idx", "hv").orderBy("idx").toArrow().combine_chunks()
        if rows.num_rows == 0:
            return np.zeros(0, np.int64), np.zeros((0, self.dim))
        batch = rows.to_batches()[0]
        values = vector_rows(batch.column("hv"))
        if np.iscomplexobj(values) and self.vsa == "HRR":
            values = values[:, : self.dim // 2 + 1]  # already a spectrum
        else:
            values = to_engine(values, self.vsa)
        return batch.column("idx").to_numpy(zero_copy_only=False).astype(np.int64), values


def _component(vsa: str, seed: int, idx: Column, d: Column, dim: int) -> Column:
    digest = keyed_md5(seed, idx, d)
    if vsa == "MAP":
        return F.when(F.substring(digest, 1, 1) < "8", 1.0).otherwise(-1.0)
    if vsa == "HRR":
        radius = F.sqrt(F.lit(-2.0) * F.log(unit_uniform(digest, 1)))
        return radius * F.cos(F.lit(2 * math.pi) * unit_uniform(digest, 14)) / F.lit(math.sqrt(dim))
    return F.lit(2 * math.pi) * unit_uniform(digest, 1)


def make_codebook(spark: SparkSession, bins: Sequence[int], dim: int, vsa: str, seed: int) -> Codebook:
    """One vector per tuple of the bins. MAP entries are ±1, HRR entries N(0, 1/D), FHRR entries unit phasors."""
    rows = math.prod(bins)
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    values = F.transform(places, lambda d: _component(vsa, seed, F.col("idx"), d, dim))
    table = spark.range(rows).withColumnRenamed("id", "idx").withColumn("hv", values)
    if vsa == "FHRR":
        phases = F.col("hv")
        table = table.withColumn("hv", F.struct(F.transform(phases, F.cos).alias("re"), F.transform(phases, F.sin).alias("im")))
    return Codebook(table, tuple(bins), dim, vsa, rows)


def with_index(nodes: DataFrame, bins: Sequence[int], on_unknown: str = "error", feat: str = "feat") -> DataFrame:
    """Append ``idx``. A tuple outside the bins raises, or its row is dropped."""
    index = feature_index(feat, bins)
    if on_unknown == "drop":
        return nodes.withColumn("idx", index).filter(F.col("idx").isNotNull())
    if on_unknown != "error":
        raise ValueError("on_unknown must be 'error' or 'drop'")
    message = F.concat(F.lit("feature tuple outside the bins: "), F.coalesce(F.to_json(feat), F.lit("null")))
    return nodes.withColumn("idx", F.coalesce(index, F.raise_error(message).cast("long")))


def named_rows(codebook: Codebook, rows: DataFrame, column: str) -> Codebook:
    """The codebook with those rows only that a column names: the others are left out before their vectors are made."""
    wanted = rows.select(F.col(column).alias("idx")).distinct()
    return replace(codebook, table=codebook.table.join(wanted, "idx", "left_semi"))


def lookup_hv(nodes: DataFrame, codebook: Codebook) -> DataFrame:
    """Append the vector of each node's tuple."""
    return with_index(nodes, codebook.bins).join(codebook.joinable(), "idx")


def lookup_edge_hv(edges: DataFrame, codebook: Codebook, attribute: str = "bond") -> DataFrame:
    """Append the vector of each edge's class."""
    return edges.join(codebook.joinable().withColumnRenamed("idx", attribute), attribute)


def lookup_graph_hv(graphs: DataFrame, codebook: Codebook, attribute: str = "label") -> DataFrame:
    """Append the vector of each graph's category."""
    return graphs.join(codebook.joinable().withColumnRenamed("idx", attribute), attribute)


def cartesian_bind(codebooks: Sequence[Codebook]) -> Codebook:
    """Bound vector for every combination, last codebook fastest; a single codebook is returned as it is.

    The combinations come from a range and are resolved by equi-joins, one per codebook."""
    if not codebooks:
        raise ValueError("need at least one codebook")
    if len(codebooks) == 1:
        return codebooks[0]
    sizes = [c.rows for c in codebooks]
    first = codebooks[0]
    total = math.prod(sizes)
    spark = first.table.sparkSession
    combos = spark.range(total).withColumnRenamed("id", "idx").withColumn("_at", feature_tuple("idx", sizes))
    out = None
    for i, book in enumerate(c.spectral() for c in codebooks):
        part = book.joinable().select(F.col("idx").alias("_part"), F.col("hv").alias("_hv"))
        combos = combos.withColumn("_key", F.col("_at")[i].cast("long"))
        joined = combos.join(part, combos["_key"] == part["_part"])
        out = F.col("_hv") if i == 0 else V.bind("hv", "_hv", first.vsa)
        combos = joined.withColumn("hv", out).drop("_part", "_hv", "_key")
    bins = tuple(b for c in codebooks for b in c.bins)
    return Codebook(combos.select("idx", "hv"), bins, first.dim, first.vsa, total)


multibind = cartesian_bind


def pair_codebook(pairs: DataFrame, codebook: Codebook) -> DataFrame:
    """Bound vector for each given (a, b) pair of idx values; only pairs that occur, never all of them."""
    book = codebook.spectral()
    left = book.joinable().select(F.col("idx").alias("a"), F.col("hv").alias("_ha"))
    right = book.joinable().select(F.col("idx").alias("b"), F.col("hv").alias("_hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", V.bind("_ha", "_hb", book.vsa).alias("hv"))


def prune_codebook(codebook: Codebook, observed: DataFrame) -> Codebook:
    """Keep the observed tuples. ``pos`` is the new index in sorted tuple order; ``idx`` stays the flat index."""
    wanted = cut_lineage(with_index(observed, codebook.bins).select("idx").distinct())
    rows = wanted.count()
    if rows <= BROADCAST_KEYS:
        ranked = wanted.withColumn("pos", (F.row_number().over(Window.orderBy("idx")) - 1).cast("long"))
    else:
        ranked = with_global_rank(wanted, [F.col("idx")], "pos")
    table = codebook.table.select("idx", "hv").join(ranked, "idx")
    return replace(codebook, table=table.withColumn("feat", feature_tuple("idx", codebook.bins)), rows=rows)


def rebuild_codebook(codebook: Codebook, seed: int) -> Codebook:
    """The full table of a pruned codebook, from its seed."""
    return make_codebook(codebook.table.sparkSession, codebook.bins, codebook.dim, codebook.vsa, seed)
