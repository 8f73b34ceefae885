"""What the corpus operators share: shared-folder tables and text expressions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Used only by a local master that names no folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Folders of tables that this process made and has not deleted.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local one if a local master leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: later stages start from files that every executor
    can read, so a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tensorloom-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tensorloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _made.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tensorloom_path", None)
        if path:
            _delete(t.sparkSession, path)


@contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes the tables that were made inside, but for those put into the list that it gives.

    A result that is not written yet still reads the tables of its operator: write
    it inside, or keep all tables and call :func:`sweep` when it is no longer needed.
    """
    before, kept = set(_made), list(keep)
    try:
        yield kept
    finally:
        stay = {getattr(t, "_tensorloom_path", None) for t in kept}
        for path in [p for p in _made if p not in before and p not in stay]:
            _delete(_made[path], path)


def sweep() -> None:
    """Delete all tables that this process has made: results that were not written are lost."""
    for path, spark in list(_made.items()):
        _delete(spark, path)


#: In a Python worker: the operator whose tables it holds, and what empties them.
_held: list = []


def hold(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Called in a worker before a task of ``owner``: what another operator has left there goes.

    So an operator's memory lasts from task to task, and a worker holds that of one operator only.
    """
    if _held and _held[0] != owner:
        _held[1]()
    _held[:] = [owner, release]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    # Splitting at one plain character needs no pattern matching.
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def windows(ws: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` words; of fewer words, the whole run as one; none of none.

    Words are hashed once and runs by their words' hashes.
    """
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    of = lambda h, k: F.xxhash64(*[F.get(h, k + j) for j in range(n)])
    starts = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts(h), lambda k: of(h, k))))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that the operator is about to add (case is ignored)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
