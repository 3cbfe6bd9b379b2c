"""Vector-symbolic algebra on array columns.

Real vectors are ``array<double>``; complex ones are ``struct<re: array<double>, im: array<double>>``. MAP works on real
vectors, FHRR on phasors, and HRR on spectra, where circular convolution is an element-wise complex product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-8
_REAL = T.ArrayType(T.DoubleType())
_SPECTRUM = T.StructType([T.StructField("re", _REAL), T.StructField("im", _REAL)])
COMPLEX_TYPE = "struct<re:array<double>,im:array<double>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _times(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def is_complex(vsa: str) -> bool:
    """Whether the engine keeps this kind in complex form."""
    return vsa in ("HRR", "FHRR")


def bind(a: Column | str, b: Column | str, vsa: str = "MAP") -> Column:
    """Element-wise product, real for MAP and complex for the spectral kinds."""
    a, b = _col(a), _col(b)
    if not is_complex(vsa):
        return _times(a, b)
    ar, ai, br, bi = a["re"], a["im"], b["re"], b["im"]
    minus = lambda x, y: x - y
    plus = lambda x, y: x + y
    return _complex(F.zip_with(_times(ar, br), _times(ai, bi), minus), F.zip_with(_times(ar, bi), _times(ai, br), plus))


def inverse(f: Column | str, vsa: str = "MAP") -> Column:
    """Inverse under ``bind``: itself for MAP, conjugate for FHRR, guarded complex reciprocal for HRR."""
    f = _col(f)
    if vsa == "MAP":
        return f
    re, im = f["re"], f["im"]
    if vsa == "FHRR":
        return _complex(re, F.transform(im, lambda v: -v))
    size = F.zip_with(re, im, lambda x, y: F.greatest(x * x + y * y, F.lit(1e-12)))
    return _complex(F.zip_with(re, size, lambda x, m: x / m), F.zip_with(im, size, lambda y, m: -y / m))


def unbind(composite: Column | str, factor: Column | str, vsa: str = "MAP") -> Column:
    """Recover the other factor of a bound vector."""
    return bind(composite, inverse(factor, vsa), vsa)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two real vectors."""
    return _sum(_times(_col(a), _col(b)))


def complex_dot(a: Column | str, b: Column | str) -> Column:
    """Real part of the inner product of two complex vectors."""
    a, b = _col(a), _col(b)
    return dot(a["re"], b["re"]) + dot(a["im"], b["im"])


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(_col(a), lambda v: v * v)))


def l2_normalize(a: Column | str) -> Column:
    """v / (‖v‖ + 1e-8)."""
    a = _col(a)
    length = F.array(norm(a) + F.lit(EPSILON))
    # The length is carried as a one-element outer loop, so it is computed once per row and not once per element.
    return F.flatten(F.transform(length, lambda n: F.transform(a, lambda v: v / n)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity with each length kept above 1e-8; null for vectors of different length."""
    a, b = _col(a), _col(b)
    lengths = F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON))
    return dot(a, b) / lengths


def sq_dist(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def identity(vsa: str, dim: int, spectral: bool = True) -> Column:
    """Neutral element of ``bind``: ones; (1, 0, ...) for HRR outside the spectrum."""
    ones = F.array_repeat(F.lit(1.0), dim)
    if vsa == "MAP":
        return ones
    if vsa == "HRR" and not spectral:
        return F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), dim - 1))
    return _complex(ones, F.array_repeat(F.lit(0.0), dim))


def _stacked(columns: list[pd.Series], job: Callable[..., np.ndarray]) -> list[np.ndarray]:
    """``job`` on matrices of the rows of equal length; rows with a null stay null."""
    out: list[np.ndarray | None] = [None] * len(columns[0])
    size = np.array([-1 if any(v is None for v in row) else len(row[0]) for row in zip(*columns, strict=True)], np.int64)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        if n:
            made = job(*(np.stack(c.iloc[rows].to_list()).astype(np.float64) for c in columns))
        else:
            made = np.zeros((len(rows), 0))
        for k, v in zip(rows, made, strict=True):
            out[k] = v
    return out


@F.pandas_udf(_SPECTRUM)
def to_spectral(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Discrete Fourier transform of real vectors."""
    for vectors in batches:
        spectra = _stacked([vectors], lambda m: np.fft.fft(m, axis=1))
        yield pd.DataFrame({"re": [None if s is None else s.real for s in spectra], "im": [None if s is None else s.imag for s in spectra]})


@F.pandas_udf(_REAL)
def from_spectral(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Real part of the inverse transform."""
    for spectra in batches:
        yield pd.Series(_stacked([spectra["re"], spectra["im"]], lambda re, im: np.fft.ifft(re + 1j * im, axis=1).real), dtype=object)


@F.pandas_udf(_REAL)
def _convolve(a: pd.Series, b: pd.Series) -> pd.Series:
    half = lambda m: np.fft.rfft(m, axis=1)
    return pd.Series(_stacked([a, b], lambda x, y: np.fft.irfft(half(x) * half(y), n=x.shape[1], axis=1)), dtype=object)


def circular_convolve(a: Column | str, b: Column | str) -> Column:
    """HRR bind of real vectors, by way of half spectra, in one function."""
    return _convolve(_col(a), _col(b))
