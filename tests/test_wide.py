"""Principal components of wide vectors."""

import numpy as np
import pyarrow as pa
import pytest

from braidvec.functions.batch import vector_column
from braidvec.operators import wide as W
from braidvec.operators.stats import pca_fit


def table(spark, x, parts=5):
    return spark.createDataFrame(pa.table([vector_column(x)], ["v"])).repartition(parts)


@pytest.mark.parametrize("kept", [2, 8])
def test_equals_the_full_matrix(spark, monkeypatch, kept):
    monkeypatch.setattr(W, "BLOCKS_KEPT", kept + 1)  # with and without restarts
    rng = np.random.default_rng(2)
    df = table(spark, rng.normal(size=(400, 64)) * np.linspace(3, 1, 64) + 4).persist()
    want, got = pca_fit(df, "v", 5), W.pca_fit_wide(df, "v", 5)
    assert np.allclose(got.components, want.components, atol=1e-6) and np.allclose(got.ratio, want.ratio[:5], atol=1e-9)
    assert np.allclose(got.mean, want.mean)


def test_very_wide_vectors(spark):
    rng = np.random.default_rng(5)
    planted = np.linalg.qr(rng.normal(size=(20_000, 3)))[0].T
    x = (rng.normal(size=(120, 3)) * [30, 20, 10]) @ planted + 0.01 * rng.normal(size=(120, 20_000))
    got = W.pca_fit_wide(table(spark, x, 3), "v", 3, tolerance=1e-6)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs((got.components * vt[:3]).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(got.ratio, s[:3] ** 2 / (s**2).sum(), rtol=1e-6)


def test_edges(spark):
    same = W.pca_fit_wide(table(spark, np.ones((6, 4))), "v", 2)
    assert same.ratio.tolist() == [0.0, 0.0] and np.allclose(same.components @ same.components.T, np.eye(2))
    one = W.pca_fit_wide(spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>"), "v", 1)
    assert one.mean.tolist() == [1.0, 2.0]
    line = W.pca_fit_wide(table(spark, np.outer(np.arange(9.0), [0.0, -2.0, 0.0])), "v", 1)
    assert np.allclose(line.components, [[0, 1, 0]]) and np.isclose(line.ratio[0], 1)
    with pytest.raises(ValueError, match="no vectors"):
        W.pca_fit_wide(spark.createDataFrame([], "v array<double>"), "v", 1)
    with pytest.raises(ValueError, match="dimensions"):
        W.pca_fit_wide(table(spark, np.ones((2, 3))), "v", 4)
