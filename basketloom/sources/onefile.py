"""Ordered text in one file, written by many tasks.

Lines are sorted over the tasks into parts, part after part, and the parts are joined: by the file system itself where it
can (HDFS joins blocks without reading them), otherwise by copying them one after the other in small pieces.  No task
and no driver holds the lines.  The file appears under its name only when it is whole.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame


def write_file(lines: DataFrame, path: str, *order: Column | str, header: str | None = None) -> str:
    """Write the only column that is not in ``order`` as lines of one file; an earlier file of that name is replaced.

    Lines without an order given stay in the order of the partitions.  No line gives an empty file (or the header).
    """
    spark = lines.sparkSession
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    folder = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.parts")
    files.delete(folder, True)
    (lines.orderBy(*order) if order else lines).select("value").write.text(folder.toString())
    parts = sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
    out = files.create(whole, True)
    try:
        if header is not None:
            out.write(bytearray((header + "\n").encode()))
        if not _can_join(files):
            for part in parts:
                source = files.open(jvm.org.apache.hadoop.fs.Path(part))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
            parts = []
    finally:
        out.close()
    if parts:
        paths = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            paths[k] = jvm.org.apache.hadoop.fs.Path(part)
        files.concat(whole, paths)
    files.delete(target, True)
    if not files.rename(whole, target):
        raise OSError(f"cannot name the file {path}")
    files.delete(folder, True)
    return path


def _can_join(files) -> bool:
    try:
        return files.getScheme() == "hdfs"
    except Py4JError:  # a file system that does not say what it is
        return False
