"""Operator 12 against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def plain(rows, components=8):
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(np.float64)) + 100000
    n = len(x)
    s = x.sum(0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return y @ q / np.sqrt(e), e / np.trace(y.T @ y / n), deviation


def held(table, rows, components=8, tolerance=1e-9):
    got = whitening.whitened(table).toPandas()
    z, share, deviation = plain(rows, components)
    assert len(got) == len(rows) * components and (got["n"] == len(rows)).all() and (got["identity_error"] < 1e-8).all()
    wide = got.pivot_table(index="vec_id", columns="component", values="whitened").loc[[k for k, _ in rows]].to_numpy()
    assert np.abs(wide - z * np.sign((wide * z).sum(0))).max() < tolerance
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(share, rel=1e-10)
    assert got.groupby("vec_id")["deviation"].first().loc[[k for k, _ in rows]].tolist() == deviation


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held(table, [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_many_parts_are_added_up_in_two_steps(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(9)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    v = whitening.Covariance(table, len(rows[0][1]))
    assert v.many
    q = np.random.default_rng(1).standard_normal((v.d, 3))
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64))
    y = x - x.mean(0)
    assert v.times(q) == pytest.approx(y.T @ (y @ q) / len(y), rel=1e-9)
    assert v.trace == pytest.approx((y * y).sum() / len(y))


def test_filter_finds_close_eigenvalues_and_locks_strong_ones(spark):
    """One direction a thousand times as strong, then a slope so slight that a block of 32 has to iterate."""
    r = np.random.default_rng(2)
    d, n = 96, 3000
    basis, _ = np.linalg.qr(r.standard_normal((d, d)))
    scale = np.concatenate([[30.0], np.linspace(1.0, 0.5, d - 1)])
    x = (r.standard_normal((n, d)) * scale) @ basis.T
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held(table, rows, tolerance=1e-8)


def test_flat_spectrum_doubles_the_block(spark):
    """All directions alike: no filter tells them apart, and Rayleigh-Ritz over all dimensions does."""
    d = 40
    rows = [(i, [float(s if j == i // 2 else 0) for j in range(d)]) for i in range(2 * d) for s in [1 - 2 * (i % 2)]]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert len(got) == 16 * d and (got["identity_error"] < 1e-8).all()
    assert got["explained"].to_numpy() == pytest.approx(1 / d, rel=1e-6)


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    fine = [(i, [float(c) for c in np.float32(r.standard_normal(12))]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    odd = [(90, None), (91, []), (92, [1.0] * 11 + [None]), (93, [nan] * 12), (94, [inf] + [0.0] * 11), (95, [-inf] + [0.0] * 11), (96, [1.0] * 5), (97, [1.0] * 13)]
    table = spark.createDataFrame([(*x, "clash", "clash") for x in [*fine, *odd, fine[7]]], SCHEMA).repartition(3)
    got = whitening.whitened(table).toPandas()
    assert set(got["vec_id"]) == set(range(60)) and (got["n"] == 61).all() and len(got) == 61 * 8
    z, share, deviation = plain([*fine, fine[7]])
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation[:60]
    assert (got[got["vec_id"] == 7].groupby("component")["whitened"].nunique() == 1).all()
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(share, rel=1e-10)


def test_null_ids_stay_and_ranks_run_out(spark):
    one = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 5.0]), (2, [2.0, 3.5])], "vec_id long, embedding array<float>")
    got = whitening.whitened(one).collect()
    assert {r["component"] for r in got} == {1} and {r["vec_id"] for r in got} == {None, 1, 2}
    assert whitening.whitened(one.filter("vec_id = 1")).count() == 0
    assert whitening.whitened(one.select("vec_id", F.array(F.lit(1.0), F.lit(1.0)).alias("embedding"))).count() == 0
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_vectors_and_large_entries(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in np.float32(r.standard_normal(3000))]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whitened(table).toPandas()
    assert len(got) == 160 and (got["identity_error"] < 1e-6).all()
    big = spark.createDataFrame([(i, [float(i) * 1e30, float(-i), 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    wide = whitening.whitened(big).toPandas()
    assert (wide["identity_error"] < 1e-4).all() and wide["deviation"].isna().any()
