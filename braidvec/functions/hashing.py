"""Reproducible pseudo-random columns: the same bytes in Spark and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: exact in a double


def keyed_md5(*parts: Column | str | int) -> Column:
    """md5 over the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_number(digest: Column, start: int = 1, length: int = HEX_DIGITS) -> Column:
    """Integer value of a piece of a hex digest."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def unit_uniform(digest: Column, start: int = 1) -> Column:
    """Uniform value inside (0, 1) from thirteen hex digits."""
    return (hex_number(digest, start) + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))
