"""Contrastive grids, ensembles in files, epochs of a stream, novelty by a key store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidvec.operators import contrastive as CT
from braidvec.operators import stats as T
from braidvec.operators.encode import encode_ensemble
from braidvec.operators.walks import augment_rw
from braidvec.schema import EncoderConfig, WalkConfig
from braidvec.sources import io
from braidvec.streaming import streams as ST


def plain_score(x, y, temperature):
    x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
    z = x @ y.T / temperature

    def direction(z):
        peak = z.max(axis=1)
        return (peak + np.log(np.exp(z - peak[:, None]).sum(axis=1)) - np.diag(z)).mean()

    return (direction(z) + direction(z.T)) / 2


# At 0.0005 a shift by anything but the peak would overflow or vanish.
@pytest.mark.parametrize("temperature", [0.5, 0.0005])
def test_contrastive_grid_equals_the_matrix(spark, temperature):
    rng = np.random.default_rng(1)
    of = lambda k: None if k % 10 == 0 else k % 3
    rows = [(of(k), rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for k in range(200)]
    rows += [(1, rows[1][1], rows[1][2])] * 3 + [(2, [0.0] * 5, rows[2][2]), (7, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "grp int, x array<double>, y array<double>").repartition(5).withColumn("extra", F.lit("x"))
    got = {r["grp"]: (r["n"], r["loss"]) for r in T.info_nce(df, "grp", "x", "y", temperature, limit=20, group_rows=16, block=7).collect()}
    assert set(got) == {None, 0, 1, 2, 7}  # null, 0, 1 and 2 on the grid, 7 alone
    for key, (n, loss) in got.items():
        mine = [r for r in rows if r[0] == key]
        want = plain_score(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), temperature)
        assert n == len(mine) and math.isclose(loss, want, rel_tol=1e-9, abs_tol=1e-9)


def test_contrastive_score_of_nothing(spark):
    empty = spark.createDataFrame([], "grp int, x array<double>, y array<double>")
    assert T.info_nce(empty, "grp", "x", "y", 0.5).count() == 0


def test_no_task_of_the_grid_holds_a_batch(spark):
    """Each row goes to the g cells of its group on either side and to no other."""
    from braidvec.operators import contrastive as C

    seen = spark.sparkContext.accumulator(0)
    original = C._log_sums

    def counted(left, right, *rest):
        assert max(len(left), len(right)) <= 60  # 300 rows in 10 groups of about 30
        seen.add(len(left) * len(right))
        return original(left, right, *rest)

    rows = spark.range(300).select(F.lit(0).alias("_batch"), F.array(F.sin("id"), F.cos("id")).alias("_a"), F.array(F.cos("id"), F.sin("id")).alias("_b"), F.lit(10).alias("_g"))
    C._log_sums = counted
    try:
        assert C._scored_on_a_grid(rows, "int", 0.5, None).first()["n"] == 300
    finally:
        C._log_sums = original


@pytest.mark.parametrize("walk", [None, WalkConfig(ks=(2, 3), num_bins=4)])
def test_ensembles_come_back_from_files_with_all_books(spark, sample, tmp_path, walk):
    nodes, edges = sample
    cfg = EncoderConfig(bins=(3, 6, 2, 5), dim=8, vsa="HRR", kind="ensemble", members=((16, 2), (8, 1)), walk=walk)
    io.save_encoder(str(tmp_path / "e"), cfg, io.encoder_codebooks(spark, cfg), spark)
    back, books = io.load_encoder(spark, str(tmp_path / "e"), "ensemble")
    assert back == cfg and set(books) == {"member_0", "member_1"} | ({"full"} if walk else set())
    assert [books[f"member_{i}"].dim for i in range(2)] == [16, 8]
    ready = augment_rw(nodes, edges, walk) if walk else nodes
    want = {r["graph_id"]: r["graph_embedding"] for r in encode_ensemble(ready, edges, cfg).collect()}
    got = {r["graph_id"]: r["graph_embedding"] for r in encode_ensemble(ready, edges, back, books=books).collect()}
    assert got.keys() == want.keys() and all(len(v) == 24 and np.allclose(v, got[g]) for g, v in want.items())


def test_an_epoch_gives_every_row_once(spark, tmp_path):
    pool = spark.range(23).select((F.col("id") * 7 % 23).alias("k"), F.lit(1).alias("value"))
    seen = []
    assert ST.run_epoch(pool, ["k"], 5, str(tmp_path), lambda rows, number: seen.append((number, sorted((r["pos"], r["k"]) for r in rows.collect())))) == 5
    assert [n for n, _ in seen] == list(range(5))
    assert [pair for _, rows in seen for pair in rows] == [(i, i) for i in range(23)]
    with pytest.raises(ValueError, match="empty"):
        ST.run_epoch(pool.filter("k < 0"), ["k"], 5, str(tmp_path / "none"), lambda rows, number: None)


def test_novelty_by_a_key_store(spark, tmp_path):
    store, sink = str(tmp_path / "store"), str(tmp_path / "out")
    ST.write_key_store(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string"), "key", store, 4)
    parts = [["a", "c", "c", None], ["c", "d", "b"], ["e", "d", "a"]]

    def read():
        return spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    for i, keys in enumerate(parts):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ST.run_novel(read(), "key", store, 4, sink, str(tmp_path / "check"))
    got = sorted((r["key"], r["batch"]) for r in spark.read.parquet(sink).collect())
    assert got == [("c", 0), ("d", 1), ("e", 2)]
    # The whole stream again, as after a loss of its progress: the same keys under the same numbers.
    ST.run_novel(read(), "key", store, 4, sink, str(tmp_path / "again"))
    assert sorted(r["key"] for r in spark.read.parquet(sink).collect()) == ["c", "d", "e"]
    folded = str(tmp_path / "folded")
    ST.fold_key_store(spark, store, folded, "key")
    assert sorted(r["key"] for r in spark.read.parquet(folded).collect()) == ["a", "b", "c", "d", "e"]
    ST.run_novel(read(), "key", folded, 4, str(tmp_path / "rest"), str(tmp_path / "third"))
    assert spark.read.parquet(f"{tmp_path}/rest").count() == 0


def test_a_finer_grid_than_the_tasks_need_is_not_made(spark):
    """The number of groups a row goes to is bounded by the tasks, whatever the batch, until a group passes its bound in numbers."""
    sides = spark.createDataFrame([(40,), (1000,), (10**6,), (10**9,)], "n long").select(CT._grid_side(F.col("n"), 16, 32, 12)).collect()
    assert [r[0] for r in sides] == [3, 10, 16, math.ceil(10**9 / (CT.GROUP_CELLS // 32))]


@pytest.mark.parametrize("temperature", [0.5, -0.2, 1 / 300])
def test_bounded_logits_give_the_sums_of_the_peaks(monkeypatch, temperature):
    rng = np.random.default_rng(4)
    x, y = (CT._unit(rng.normal(size=(n, 6))) for n in (301, 2100))
    x[3] = 0.0
    y[:300] = x[:300]
    shared = CT._log_sums(x, y, temperature, None)
    monkeypatch.setattr(CT, "SHARED_PEAK", 0.0)
    own = CT._log_sums(x, y, temperature, 7)
    for k in (0, 2):
        assert np.allclose(shared[k] + np.log(shared[k + 1]), own[k] + np.log(own[k + 1]), rtol=1e-12, atol=1e-12)
