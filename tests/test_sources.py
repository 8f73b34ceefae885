from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest

from tensorloom.frame import TensorFrame
from tensorloom.sources import files
from tensorloom.streaming import windows


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n\n1;2\n 3;"4"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "int", sep=";").collect()] == [(1, 2), (3, 4)]
    t = TensorFrame.from_nested(spark, np.arange(8).reshape(2, 2, 2))
    files.write_csv(t, str(tmp_path / "b"))
    assert files.read_coordinates(spark, str(tmp_path / "b"), "bigint").equals(t)


@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i4", ">i8", "<u4", ">u8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy(spark, tmp_path, kind, order):
    a = np.asarray(np.arange(8).reshape(2, 4), dtype=kind, order=order)
    np.save(tmp_path / "a.npy", a)
    assert np.array_equal(files.read_npy(spark, str(tmp_path / "a.npy")).collect(), a)


def test_write_npy(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    files.write_npy(TensorFrame.from_nested(spark, a), str(tmp_path / "o.npy"))
    assert np.array_equal(np.load(tmp_path / "o.npy"), a)
    np.save(tmp_path / "bad.npy", np.array([1], dtype="i2"))
    with pytest.raises(ValueError):
        files.read_npy(spark, str(tmp_path / "bad.npy"))


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_images(spark, tmp_path, kind):
    px = np.random.default_rng(0).integers(0, 256, (3, 4, 5)).astype(np.uint8)
    (tmp_path / f"a.{kind}").write_bytes(files.write_image(px, kind))
    got = files.read_images(spark, str(tmp_path / f"a.{kind}")).toPandas()
    out = np.zeros_like(px)
    out[got["c"], got["h"], got["w"]] = got["v"]
    assert np.array_equal(out, px)


def test_idx(spark, tmp_path):
    px = np.arange(12, dtype=np.uint8).reshape(3, 2, 2)
    (tmp_path / "i.gz").write_bytes(gzip.compress(struct.pack(">IIII", 2051, 3, 2, 2) + px.tobytes()))
    (tmp_path / "l").write_bytes(struct.pack(">II", 2049, 3) + bytes([7, 8, 9]))
    assert [r["values"] for r in files.read_idx(spark, str(tmp_path / "i.gz")).orderBy("i").collect()] == px.reshape(3, 4).tolist()
    assert [r["values"] for r in files.read_idx(spark, str(tmp_path / "l")).orderBy("i").collect()] == [[7], [8], [9]]


def test_labelled_texts(spark, tmp_path):
    for part, name, text in (("pos", "0_9.txt", "fine"), ("neg", "1_2.txt", "poor")):
        (tmp_path / "train" / part).mkdir(parents=True)
        (tmp_path / "train" / part / name).write_text(text)
    got = sorted(map(tuple, files.read_labelled_texts(spark, str(tmp_path)).collect()))
    assert got == [("train", 0, 2, "poor"), ("train", 1, 9, "fine")]


def test_loaders(spark, tmp_path):
    for stem, n in (("train", 3), ("t10k", 2)):
        (tmp_path / f"{stem}-images-idx3-ubyte.gz").write_bytes(gzip.compress(struct.pack(">IIII", 2051, n, 1, 2) + bytes(range(2 * n))))
        (tmp_path / f"{stem}-labels-idx1-ubyte.gz").write_bytes(gzip.compress(struct.pack(">II", 2049, n) + bytes(range(5, 5 + n))))
    got = sorted((*r[:3], tuple(r["values"])) for r in files.load_mnist(spark, str(tmp_path)).collect())
    assert got == [(s, k, 5 + k, (2 * k, 2 * k + 1)) for s, n in (("test", 2), ("train", 3)) for k in range(n)]
    (tmp_path / "aclImdb" / "test" / "pos").mkdir(parents=True)
    (tmp_path / "aclImdb" / "test" / "pos" / "4_8.txt").write_text("good")
    assert [tuple(r) for r in files.load_imdb(spark, str(tmp_path / "aclImdb")).collect()] == [("test", 8, "good")]


def test_store(spark, tmp_path):
    s = files.TensorStore(spark, str(tmp_path / "s"))
    a, b = (TensorFrame.from_nested(spark, np.arange(n)) for n in (3, 4))
    assert s.write(a) == "Tensor_0" and s.write(b, "x", group="g") == "g/x"
    assert s.read().shape == (4,) and s.read("Tensor_0").equals(a)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = windows.read_events(spark, str(tmp_path / "e"), e._jdf.schema().toDDL())
    q = windows.windowed(stream, "1 hour", None, None, "ts", "value", "event_type").select("start", "event_type", "n")
    windows.to_memory(q, "windows_test", "complete")
    want = windows.windowed(e, "1 hour", None, None, "ts", "value", "event_type").select("start", "event_type", "n")
    assert sorted(map(tuple, spark.table("windows_test").collect())) == sorted(map(tuple, want.collect()))
