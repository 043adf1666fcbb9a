"""Tables and files that one operator writes and later jobs of it read.

Everything goes below the folder that the session names in ``spark.checkpoint.dir``, which driver and
executors share.  Where that setting is absent a folder of our own is chosen on a local master (tests,
notebooks); on a cluster its absence is an error, since executors do not see each other's folders.
A written table cuts the lineage: when executors are lost, later stages read it again from there.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL = "file:///tmp/basketloom-shared"
#: Spark's setting that has an execution's shuffle files deleted when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark can write to."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive; no two calls give the same one."""
    return f"{shared_dir(spark)}/basketloom/{uuid.uuid4().hex}/{name}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path in the shared folder, and the path within it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores after it until no column bears it (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that whatever names they bear can't clash with an operator's own."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


class _Session(threading.local):
    """Of each thread: paths of the tables written within each open ``scratch``, the innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_session = _Session()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh scan; Spark deletes the write's shuffle files when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _session.open:
        _session.open[-1].append(path)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes, at its end, the tables written meanwhile in this thread, but for those that the given function was called with.

    Kept tables belong to the scratch around this one, if there is any; the tables that a returned plan reads stay
    until the user removes the folder or calls ``remove``.  Nothing that still reads a deleted table may be returned.
    """
    kept: list[str] = []

    def keep(df: DataFrame, path: str | None = None) -> DataFrame:
        kept.append(path or df.table_path)
        return df

    _session.open.append([])
    try:
        yield keep
    finally:
        for path in _session.open.pop():
            if path not in kept:
                remove(spark, path)
        if _session.open:
            _session.open[-1].extend(kept)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
