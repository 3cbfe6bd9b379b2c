"""Small column helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidvec.plans.tables import ORDER_BINS


def r6(c: Column | str) -> Column:
    """Round to six places without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6_scaled(c: Column | str) -> Column:
    """Round to six places as the SQL engine does, which rounds the number times 10**6: a mean whose decimals end in a five after
    the sixth, as of 640 numbers, goes to the side that this product lies on."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def text(feat: Column | str = "feat") -> Column:
    """Comma-separated form of an integer array."""
    feat = F.col(feat) if isinstance(feat, str) else feat
    return F.concat_ws(",", feat.cast("array<string>"))


def long_rows(df: DataFrame, keys: list[str], vector: str, integer: bool = False, name: str = "v") -> DataFrame:
    """One row per vector position: (keys, d, v)."""
    cells = df.select(*keys, F.posexplode(vector).alias("d", "_v"))
    value = F.rint("_v").cast("long") if integer else r6("_v")
    return cells.select(*keys, F.col("d").cast("long").alias("d"), value.alias(name))


BINS = ORDER_BINS
ROWS = 180
