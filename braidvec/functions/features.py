"""Column functions over feature tuples, classes and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidvec.schema import WalkConfig

# Element symbols in index order.
SYMBOLS_SMALL = ("C", "N", "O", "F")
SYMBOLS_LARGE = ("Br", "C", "Cl", "F", "I", "N", "O", "P", "S")

# Bond class numbers; anything else is class 0.
BOND_CLASSES = {"single": 1, "double": 2, "triple": 3, "aromatic": 4}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def feature_index(feat: Column | str, bins: Sequence[int]) -> Column:
    """Flat index of a tuple, last position fastest; null for a tuple outside the bins."""
    feat = _col(feat)
    inside = F.size(feat) == len(bins)
    index = F.lit(0).cast("long")
    for i, size in enumerate(bins):
        value = F.get(feat, F.lit(i)).cast("long")
        inside = inside & (value >= 0) & (value < size)
        index = index * F.lit(size) + value
    return F.when(inside, index)


def feature_tuple(index: Column | str, bins: Sequence[int]) -> Column:
    """Inverse of ``feature_index``; null outside the range."""
    index = _col(index)
    parts, rest = [], prod(bins)
    for size in bins:
        rest //= size
        parts.append(F.pmod(F.floor(index / F.lit(rest)).cast("long"), F.lit(size)).cast("int"))
    return F.when((index >= 0) & (index < prod(bins)), F.array(*parts))


def charge_class(charge: Column | str, mode: str) -> Column:
    """Class of a formal charge. ``raw`` keeps non-negative values and sends negative ones to 2 (so +2 meets −1),
    ``sign`` looks at the sign only, ``exact`` knows 0, +1 and −1 and sends the rest to 0."""
    charge = _col(charge)
    if mode == "raw":
        return F.when(charge >= 0, charge).otherwise(2)
    if mode == "sign":
        return F.when(charge == 0, 0).when(charge > 0, 1).otherwise(2)
    if mode == "exact":
        return F.when(charge == 1, 1).when(charge == -1, 2).otherwise(0)
    raise ValueError(f"unknown charge mode {mode!r}")


def encode_node_features(
    df: DataFrame,
    symbols: Sequence[str] = SYMBOLS_LARGE,
    charge_mode: str = "raw",
    clamp: bool = False,
    with_ring: bool = True,
    on_unknown: str = "error",
) -> DataFrame:
    """Append ``feat`` built from the columns symbol, degree, charge, hs and in_ring.

    ``clamp`` limits degree−1 to 5 and hydrogens to 3. An unknown symbol raises, or drops its row."""
    table = F.create_map(*[F.lit(v) for i, s in enumerate(symbols) for v in (s, i)])
    kind = F.try_element_at(table, F.col("symbol"))
    if on_unknown == "error":
        message = F.concat(F.lit("unknown symbol "), F.coalesce(F.col("symbol"), F.lit("null")))
        kind = F.coalesce(kind, F.raise_error(message).cast("int"))
    elif on_unknown != "drop":
        raise ValueError("on_unknown must be 'error' or 'drop'")
    degree = F.greatest(F.col("degree") - 1, F.lit(0))
    hs = F.col("hs")
    if clamp:
        degree, hs = F.least(degree, F.lit(5)), F.least(hs, F.lit(3))
    parts = [kind, degree, charge_class("charge", charge_mode), hs]
    if with_ring:
        parts.append(F.col("in_ring").cast("int"))
    out = df.withColumn("feat", F.array(*[p.cast("int") for p in parts]))
    return out.filter(F.col("feat")[0].isNotNull()) if on_unknown == "drop" else out


def one_hot_concat(feat: Column | str, bins: Sequence[int]) -> Column:
    """Concatenated one-hot blocks of a tuple, as doubles."""
    feat = _col(feat)
    cells = [F.when(F.get(feat, F.lit(i)) == c, 1.0).otherwise(0.0) for i, size in enumerate(bins) for c in range(size)]
    return F.array(*cells)


def one_hot_argmax(vector: Column | str, bins: Sequence[int]) -> Column:
    """Position of the first maximum of each block."""
    vector, parts, begin = _col(vector), [], 1
    for size in bins:
        block = F.slice(vector, begin, size)
        parts.append((F.array_position(block, F.array_max(block)) - 1).cast("int"))
        begin += size
    return F.array(*parts)


def bond_class(name: Column | str) -> Column:
    """Class number of a bond name; unknown and null are 0."""
    table = F.create_map(*[F.lit(v) for pair in BOND_CLASSES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.lower(_col(name))), F.lit(0))


def _clamped(position: Column, num_bins: int) -> Column:
    return F.least(F.greatest(position.cast("int"), F.lit(0)), F.lit(num_bins - 1))


def bin_uniform(value: Column | str, num_bins: int) -> Column:
    """Equal-width bin on [0, 1], in single precision, truncating."""
    v = _col(value).cast("float")
    return _clamped((v * F.lit(float(num_bins)).cast("float")).cast("float"), num_bins)


def bin_clipped(value: Column | str, num_bins: int, lo: float, hi: float) -> Column:
    """Equal-width bin on [lo, hi]; values outside go to the end bins."""
    f = lambda x: F.lit(float(x)).cast("float")
    scaled = ((_col(value).cast("float") - f(lo)).cast("float") / f(hi - lo)).cast("float")
    return _clamped((scaled * f(num_bins)).cast("float"), num_bins)


def bin_quantile(value: Column | str, num_bins: int, bounds: Sequence[float]) -> Column:
    """Number of boundaries that are not above the value."""
    v = _col(value).cast("float")
    passed = F.lit(0)
    for b in bounds:
        passed = passed + F.when(v >= F.lit(float(b)).cast("float"), 1).otherwise(0)
    return _clamped(passed, num_bins)


def bin_walk(value: Column | str, k: int, walk: WalkConfig) -> Column:
    """Bin by the first rule that applies: boundaries (uniform for a missing length), clip range, uniform."""
    if walk.boundaries is not None:
        bounds = walk.boundaries.get(k)
        return bin_uniform(value, walk.num_bins) if bounds is None else bin_quantile(value, walk.num_bins, bounds)
    if walk.clip is not None:
        return bin_clipped(value, walk.num_bins, *walk.clip)
    return bin_uniform(value, walk.num_bins)


def select_vector(node_terms: Column | str, graph_embedding: Column | str, part: str = "both") -> Column:
    """Choose the order-0 vector, the order-N vector, or both joined."""
    node_terms, graph_embedding = _col(node_terms), _col(graph_embedding)
    if part == "node":
        return node_terms
    if part == "graph":
        return graph_embedding
    if part == "both":
        return F.concat(node_terms, graph_embedding)
    raise ValueError(f"unknown part {part!r}")


def split_vector(vector: Column | str, dims: Sequence[int]) -> list[Column]:
    """Cut a vector into consecutive chunks of the given lengths."""
    vector, out, begin = _col(vector), [], 1
    for d in dims:
        out.append(F.slice(vector, begin, d))
        begin += d
    return out


def interpolate(df: DataFrame, a: str, b: str, ts: Sequence[float], out: str = "vector") -> DataFrame:
    """One row per t with (1−t)·a + t·b."""
    steps = df.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in ts])))
    return steps.withColumn(out, F.zip_with(a, b, lambda x, y: (1 - F.col("t")) * x + F.col("t") * y))


def hill_formula(counts: Mapping[str, Column | str]) -> Column:
    """Formula text: carbon first, then alphabetical; a count of one is not written, zero is left out."""
    order = sorted(counts, key=lambda s: (s != "C", s))
    parts = []
    for symbol in order:
        n = _col(counts[symbol])
        parts.append(F.when(n == 0, "").when(n == 1, symbol).otherwise(F.concat(F.lit(symbol), n.cast("string"))))
    return F.concat(*parts)


def time_bin(t: Column | str, n: int) -> Column:
    """Step number of a time in [0, 1]."""
    return F.least((_col(t) * F.lit(n)).cast("int"), F.lit(n - 1))
