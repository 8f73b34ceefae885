"""npy files by ranges and in parts, against NumPy."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.frame import TensorFrame
from tensorloom.sources import npy


@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i4", ">i8", "<u4"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_ranges(spark, tmp_path, kind, order):
    a = np.asarray(np.arange(7 * 5 * 3).reshape(7, 5, 3), dtype=kind, order=order)
    np.save(tmp_path / "a.npy", a)
    t = npy.read(spark, str(tmp_path / "a.npy"), size=100)
    assert t.shape == a.shape and t.df.rdd.getNumPartitions() == -(-a.nbytes // (100 - 100 % a.itemsize))
    assert np.array_equal(t.collect(), a)


def test_parts(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(23, 4))
    path = str(tmp_path / "parts")
    t = TensorFrame.from_nested(spark, a)
    npy.write(t, path, size=5 * 4 * 8)
    names = sorted(os.listdir(path))
    assert names == [f"part-{k:08d}.npy" for k in range(5)]
    assert np.array_equal(np.concatenate([np.load(f"{path}/{n}") for n in names]), a)
    assert np.array_equal(npy.read(spark, path, size=64).collect(), a)
    with pytest.raises(ValueError):
        npy.write(t, path)


def test_bad_input(spark, tmp_path):
    t = TensorFrame.from_nested(spark, np.arange(20.0))
    for k, df in enumerate([t.df.where("i0 <> 13"), t.df.unionAll(t.df.where("i0 = 13")), t.df.where("i0 < 16")]):
        with pytest.raises(Exception, match="missing|twice"):
            npy.write(TensorFrame(df, (20,)), str(tmp_path / f"o{k}"), size=8 * 8)
        assert not [n for n in os.listdir(tmp_path / f"o{k}") if n.startswith("part")]
    (tmp_path / "x.npy").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        npy.read(spark, str(tmp_path / "x.npy"))
    empty = np.zeros((0, 3))
    np.save(tmp_path / "e.npy", empty)
    assert npy.read(spark, str(tmp_path / "e.npy")).df.count() == 0
    npy.write(TensorFrame(t.df.where("false").select("i0", F.col("i0").alias("i1"), "v"), (0, 3)), str(tmp_path / "none"))
    assert npy.read(spark, str(tmp_path / "none")).shape == (0, 3)


def test_a_long_array_in_many_ranges(spark, tmp_path):
    """40 MB: written in eight parts, read in forty ranges, and equal sums."""
    t = TensorFrame.generate(spark, (5_000_000,), lambda i: (i * 7919 % 10007).cast("double"))
    npy.write(t, str(tmp_path / "long"), size=5_000_000)
    back = npy.read(spark, str(tmp_path / "long"), size=1_000_000)
    assert len(os.listdir(tmp_path / "long")) == 8 and back.df.rdd.getNumPartitions() == 40
    code = F.sum(F.xxhash64("i0", "v").cast("decimal(38,0)"))
    assert back.df.agg(code).first() == t.df.agg(code).first()
