"""File formats.  All paths are read by Spark, so any file system it knows will do."""

from __future__ import annotations

import ast
import gzip
import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.frame import TensorFrame


def read_csv(spark: SparkSession, path: str, kind: str = "double", header: bool = True, sep: str = ",", quote: str = '"', columns: int | None = None) -> DataFrame:
    """Rows of one element type: columns keep the header's names, or are c0, c1, ...

    Blank lines are skipped, leading white space is ignored, and quoted cells may
    hold line breaks.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("quote", quote).option("multiLine", True).option("ignoreLeadingWhiteSpace", True)
    raw = reader.csv(path)
    if columns is not None and len(raw.columns) != columns:
        raise ValueError(f"{len(raw.columns)} columns in {path}")
    names = raw.columns if header else [f"c{k}" for k in range(len(raw.columns))]
    return raw.select(*[F.col(f"`{a}`").cast(kind).alias(b) for a, b in zip(raw.columns, names, strict=True)])


def write_csv(t: TensorFrame, path: str, sep: str = ",") -> None:
    """One line per element: dimension_1, ..., value."""
    t.dense().df.select(*[F.col(f"i{k}").alias(f"dimension_{k + 1}") for k in range(t.rank)], F.col("v").alias("value")).write.csv(path, header=True, sep=sep)


def read_coordinates(spark: SparkSession, path: str, kind: str = "double", sep: str = ",") -> TensorFrame:
    """What :func:`write_csv` wrote."""
    raw = spark.read.csv(path, header=True, sep=sep)
    dims = [c for c in raw.columns if c.startswith("dimension_")]
    df = raw.select(*[F.col(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(dims)], F.col("value").cast(kind).alias("v"))
    top = df.agg(*[F.max(f"i{k}").alias(f"i{k}") for k in range(len(dims))]).first()
    return TensorFrame(df, [(x if x is not None else -1) + 1 for x in top])


# -- npy -----------------------------------------------------------------------

_NPY = {"f4", "f8", "i4", "i8", "u4", "u8"}


def npy_header(head: bytes) -> tuple[str, bool, tuple[int, ...], int]:
    """(dtype, Fortran order, shape, offset of the data)."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = head[6] >= 2
    (n,) = struct.unpack_from("<I" if wide else "<H", head, 8)
    at = 12 if wide else 10
    d = ast.literal_eval(head[at : at + n].decode("latin-1"))
    if d["descr"][1:] not in _NPY:
        raise ValueError(f"element type {d['descr']} is not supported")
    return d["descr"], d["fortran_order"], tuple(d["shape"]), at + n


def read_npy(spark: SparkSession, path: str, kind: str = "double") -> TensorFrame:
    """One array per file; the file is parsed by an executor."""
    files = spark.read.format("binaryFile").load(path)
    _, _, shape, _ = npy_header(bytes(files.select(F.expr("substring(content, 1, 65600)")).first()[0]))

    def cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                descr, fortran, dims, at = npy_header(content)
                a = np.frombuffer(content, np.dtype(descr), math.prod(dims), at)
                pos = np.arange(a.size)
                index = np.unravel_index(pos, dims, order="F" if fortran else "C") if dims else (pos,)
                yield pd.DataFrame({**{f"i{k}": x.astype("int64") for k, x in enumerate(index)}, "v": a.astype(float) if a.dtype.kind == "f" else a.astype("int64") if a.dtype.kind == "i" or a.dtype.itemsize < 8 else a.astype(float)})

    dims = shape or (1,)
    cols = ", ".join(f"i{k} bigint" for k in range(len(dims)))
    raw = "double" if kind in ("double", "float") else "bigint"
    out = files.select("content").mapInPandas(lambda it: (p.astype({"v": float if raw == "double" else "int64"}) for p in cells(it)), f"{cols}, v {raw}")
    return TensorFrame(out.withColumn("v", F.col("v").cast(kind)), dims)


def npy_bytes(a: np.ndarray) -> bytes:
    """The array as an npy file, version 1 unless the header is too long for it."""
    import io

    buf = io.BytesIO()
    np.lib.format.write_array(buf, np.ascontiguousarray(a), allow_pickle=False)
    return buf.getvalue()


def write_npy(t: TensorFrame, path: str) -> None:
    """One file with the whole array: for arrays that fit the driver."""
    data = npy_bytes(t.collect())
    spark = t.df.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(data)
    out.close()


# -- images, idx, texts -----------------------------------------------------------


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, c, h, w, v): channels first, one row per value; channels are red, green, blue."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    cells = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.expr("data").substr(i, F.lit(1))), 16, 10).cast("int"))).alias("p", "v")
    flat = img.select("origin", "height", "width", "nChannels", cells)
    n = F.col("nChannels")
    return flat.select("origin", F.when(n >= 3, 2 - F.pmod("p", n)).otherwise(F.pmod("p", n)).alias("c"), F.expr("p div nChannels div width").alias("h"), F.expr("p div nChannels % width").alias("w"), "v")


def write_image(pixels: np.ndarray, kind: str) -> bytes:
    """CHW bytes as an uncompressed bmp or tga file, or as png."""
    import zlib

    c, h, w = pixels.shape
    rgb = np.moveaxis(pixels, 0, -1).astype(np.uint8)
    rgb = np.repeat(rgb, 3, axis=2) if c == 1 else rgb[:, :, :3]
    if kind == "png":
        raw = b"".join(b"\0" + row.tobytes() for row in rgb)
        part = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    bgr = rgb[:, :, ::-1]
    if kind == "tga":
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 24, 0x20) + bgr.tobytes()
    if kind == "bmp":
        pad = b"\0" * (-w * 3 % 4)
        body = b"".join(row.tobytes() + pad for row in bgr[::-1])
        return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    raise ValueError(f"no encoder for {kind}")


def idx_array(content: bytes) -> np.ndarray:
    """An idx file, gzipped or not: images (magic 2051) or labels (magic 2049)."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    (magic,) = struct.unpack_from(">I", data)
    if magic not in (2049, 2051):
        raise ValueError(f"magic number {magic}")
    dims = struct.unpack_from(f">{magic & 255}I", data, 4)
    return np.frombuffer(data, np.uint8, math.prod(dims), 4 + 4 * len(dims)).reshape(dims)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """(i, values): one row per image or label, in file order."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                a = idx_array(content)
                for at in range(0, len(a), 4096):
                    b = a[at : at + 4096].reshape(len(a[at : at + 4096]), -1).astype("int32")
                    yield pd.DataFrame({"i": np.arange(at, at + len(b)), "values": list(b)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "i long, values array<int>")


def read_labelled_texts(spark: SparkSession, path: str, classes: Sequence[str] = ("neg", "pos")) -> DataFrame:
    """(section, label, rating, text) of <section>/<class>/<number>_<rating>.txt files."""
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    pattern = r"([^/]+)/(" + "|".join(classes) + r")/\d+_(\d+)\.txt$"
    part = lambda k: F.regexp_extract("file", pattern, k)
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), part(2)).cast("int") - 1
    return raw.where(part(2) != "").select(part(1).alias("section"), label.alias("label"), part(3).cast("int").alias("rating"), F.col("value").alias("text"))


def load_mnist(spark: SparkSession, folder: str) -> DataFrame:
    """(section, i, label, values) of the four gzipped files of a digit or fashion data set in ``folder``.

    Nothing is fetched: the files have their published names.
    """

    def section(name: str, stem: str) -> DataFrame:
        images, labels = (read_idx(spark, f"{folder}/{stem}-{kind}-ubyte.gz") for kind in ("images-idx3", "labels-idx1"))
        return images.join(labels.select("i", F.element_at("values", 1).alias("label")), "i").select(F.lit(name).alias("section"), "i", "label", "values")

    return section("train", "train").unionByName(section("test", "t10k"))


def load_imdb(spark: SparkSession, folder: str) -> DataFrame:
    """(section, label, text) of unpacked reviews; the label is the rating in a file's name."""
    return read_labelled_texts(spark, folder).select("section", F.col("rating").alias("label"), "text")


# -- named tensors -----------------------------------------------------------------


class TensorStore:
    """A folder of named tensors: one Parquet partition each, shapes beside them.

    Groups are part of the name; reading without a name gives the last written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _catalog(self) -> DataFrame:
        return self.spark.read.schema("name string, shape array<long>, kind string, number long").parquet(f"{self.path}/_catalog")

    def names(self) -> list[str]:
        try:
            return [r["name"] for r in self._catalog().orderBy("number").collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def write(self, t: TensorFrame, name: str | None = None, group: str | None = None) -> str:
        known = self.names()
        name = name or f"Tensor_{len(known)}"
        name = f"{group}/{name}" if group else name
        if name in known:
            raise ValueError(f"{name} is there already")
        t.dense().df.write.parquet(f"{self.path}/data/{name}")
        row = [(name, list(t.shape), dict(t.df.dtypes)["v"], len(known))]
        self.spark.createDataFrame(row, "name string, shape array<long>, kind string, number long").write.mode("append").parquet(f"{self.path}/_catalog")
        return name

    def read(self, name: str | None = None, group: str | None = None) -> TensorFrame:
        known = self._catalog()
        if name is None:
            row = known.orderBy(F.desc("number")).first()
        else:
            row = known.where(F.col("name") == (f"{group}/{name}" if group else name)).first()
        if row is None:
            raise KeyError(name)
        return TensorFrame(self.spark.read.parquet(f"{self.path}/data/{row['name']}"), row["shape"])
