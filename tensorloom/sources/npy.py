"""npy files of any length as a Spark data source: read by byte ranges, written in parts.

A path is one npy file, or a folder of them: parts in the order of their names that
follow each other along the first axis, as :func:`write` leaves them.  The driver
reads headers only.  Paths are local or those of a file system that Arrow knows.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tensorloom.frame import TensorFrame
from tensorloom.sources.files import npy_header

#: Bytes of a range that one task reads, and of a part that is written.
RANGE = 1 << 26
#: Values per Arrow batch.
BATCH = 1 << 16


@dataclass
class Part:
    path: str
    descr: str
    fortran: bool
    shape: tuple[int, ...]
    offset: int
    #: Rows of the first axis in the parts before.
    before: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header(system: fs.FileSystem, path: str) -> tuple[str, bool, tuple[int, ...], int]:
    with system.open_input_file(path) as f:
        head = f.read(12)
        if len(head) < 12:
            raise ValueError(f"{path} is not an npy file")
        n = struct.unpack_from("<I" if head[6] >= 2 else "<H", head, 8)[0]
        return npy_header(head + f.read(n))


def parts_of(path: str) -> list[Part]:
    """The file, or the files of the folder, with where each begins along the first axis."""
    system, at = _opened(path)
    found = [at]
    if system.get_file_info(at).type == fs.FileType.Directory:
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".npy") and not x.base_name.startswith(("_", ".")))
        if not found:
            raise ValueError(f"no npy files in {path}")
    out: list[Part] = []
    before = 0
    for f in found:
        descr, fortran, shape, offset = _header(system, f)
        if out and (descr, shape[1:], len(shape)) != (out[0].descr, out[0].shape[1:], len(out[0].shape)):
            raise ValueError(f"{f} does not continue {found[0]}")
        out.append(Part(f, descr, fortran, shape or (1,), offset, before))
        before += out[-1].shape[0]
    return out


def _kind(descr: str) -> str:
    return "double" if descr[1] == "f" or descr[1:] == "u8" else "bigint"


class _Range(InputPartition):
    def __init__(self, part: Part, first: int, last: int):
        self.part, self.first, self.last = part, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in parts_of(self.path):
            n, step = math.prod(p.shape), max(1, self.size // np.dtype(p.descr).itemsize)
            out += [_Range(p, a, min(a + step, n)) for a in range(0, n, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an array without elements has no range
            return
        p, kind = partition.part, np.dtype(partition.part.descr)
        system, _ = _opened(self.path)
        with system.open_input_file(p.path) as f:
            f.seek(p.offset + partition.first * kind.itemsize)
            for a in range(partition.first, partition.last, BATCH):
                b = min(a + BATCH, partition.last)
                raw = f.read((b - a) * kind.itemsize)
                if len(raw) < (b - a) * kind.itemsize:
                    raise ValueError(f"{p.path} ends early")
                at = np.unravel_index(np.arange(a, b), p.shape, order="F" if p.fortran else "C")
                cols = {f"i{k}": (x + p.before * (k == 0)).astype(np.int64) for k, x in enumerate(at)}
                v = np.frombuffer(raw, kind).astype(np.float64 if _kind(p.descr) == "double" else np.int64)
                yield pa.RecordBatch.from_pydict({**cols, "v": v})


@dataclass
class _Written(WriterCommitMessage):
    #: (name as written, final name)
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Rows come sorted within tasks by part and place; names become final when all tasks have ended."""

    def __init__(self, path: str, shape: tuple[int, ...], rows: int, descr: str):
        self.path, self.shape, self.rows, self.descr = path, shape, rows, descr

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, home = _opened(self.path)
        files: list[tuple[str, str]] = []
        part, out, due, last = -1, None, 0, -1
        width = math.prod(self.shape[1:])
        for batch in batches:
            where, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(self.descr)
            slabs = where // max(self.rows * width, 1)
            cuts = [0, *(np.flatnonzero(np.diff(slabs)) + 1).tolist(), len(where)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if slabs[a] != part:
                    self._close(out, due)
                    part = int(slabs[a])
                    n = min(self.rows, self.shape[0] - part * self.rows)
                    name, due, last = f"part-{part:08d}.npy", n * width, part * self.rows * width - 1
                    files.append((f"_{name}.{uuid.uuid4().hex}", name))
                    out = system.open_output_stream(f"{home}/{files[-1][0]}")
                    np.lib.format.write_array_header_1_0(out, {"descr": self.descr, "fortran_order": False, "shape": (n, *self.shape[1:])})
                steps = np.diff(where[a:b], prepend=last)
                if (steps != 1).any():
                    raise ValueError("an element is missing or there twice")
                out.write(v[a:b].tobytes())
                due, last = due - (b - a), int(where[b - 1])
        self._close(out, due)
        return _Written(files)

    @staticmethod
    def _close(out, due: int) -> None:
        if out is not None:
            out.close()
            if due:
                raise ValueError(f"{due} elements are missing")

    def commit(self, messages: list[_Written]) -> None:
        system, home = _opened(self.path)
        done = [f for m in messages if m for f in m.files]
        if len(done) != -(-self.shape[0] // self.rows) and math.prod(self.shape):
            self.abort(messages)
            raise ValueError("elements are missing")
        for now, then in done:
            system.move(f"{home}/{now}", f"{home}/{then}")

    def abort(self, messages: list[_Written]) -> None:
        system, home = _opened(self.path)
        for now, _ in [f for m in messages if m for f in m.files]:
            system.delete_file(f"{home}/{now}")


class NpySource(DataSource):
    """Format ``npy`` with option ``path``; option ``range`` is the bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        p = parts_of(self.options["path"])[0]
        return ", ".join(f"i{k} bigint" for k in range(len(p.shape))) + f", v {_kind(p.descr)}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        shape = tuple(int(x) for x in self.options["shape"].split(","))
        return _Writer(self.options["path"], shape, int(self.options["rows"]), self.options["descr"])


def read(spark: SparkSession, path: str, size: int = RANGE) -> TensorFrame:
    """The array at ``path``; each task reads a range of about ``size`` bytes."""
    spark.dataSource.register(NpySource)
    parts = parts_of(path)
    shape = (sum(p.shape[0] for p in parts), *parts[0].shape[1:])
    return TensorFrame(spark.read.format("npy").option("path", path).option("range", size).load(), shape)


def write(t: TensorFrame, path: str, descr: str = "<f8", size: int = RANGE) -> None:
    """``t`` as a folder of npy files of about ``size`` bytes, cut along the first axis.

    The folder must be new or empty.  Elements that are missing or there twice are an
    error; what was written before it is found is not given a final name.
    """
    spark = t.df.sparkSession
    spark.dataSource.register(NpySource)
    system, home = _opened(path)
    system.create_dir(home, recursive=True)
    if system.get_file_info(fs.FileSelector(home)):
        raise ValueError(f"{path} is not empty")
    if not t.size:
        with system.open_output_stream(f"{home}/part-00000000.npy") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": descr, "fortran_order": False, "shape": t.shape})
        return
    width = math.prod(t.shape[1:])
    rows = max(1, size // (width * np.dtype(descr).itemsize))
    flat = t.dense().df.select(t.linear().alias("p"), F.col("v").cast("double" if np.dtype(descr).kind == "f" else "bigint").alias("v"))
    n = -(-t.shape[0] // rows)
    dealt = flat.repartition(min(n, 4096), F.call_function("div", F.col("p"), F.lit(rows * width))).sortWithinPartitions("p")
    dealt.write.format("npy").option("path", path).option("shape", ",".join(map(str, t.shape))).option("rows", rows).option("descr", descr).mode("append").save()
