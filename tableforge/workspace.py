"""The folder all executors share, for written intermediate results and test tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession

_BLOCK = 4 * 1024 * 1024


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tableforge-")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster must name one,
    since a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder name below the shared root that nobody has used yet."""
    return f"{shared_root(spark)}/tableforge/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """The names directly in a folder, in order, from one listing."""
    path, files = _file_system(spark, folder)
    return sorted(status.getPath().getName() for status in files.listStatus(path))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it."""
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def file_sizes(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and bytes of the files directly in a folder, or of one file, in order of their names."""
    path, files = _file_system(spark, folder)
    return sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(path) if s.isFile())


def join_files(spark: SparkSession, parts: Sequence[str], target: str) -> None:
    """Make one file of some files, in order; ``target`` must not exist yet and the parts may be gone then.

    A file system that can chain files' blocks moves no byte. Another one has the bytes copied in blocks of a few
    megabytes; rows are never read, and nothing whole is held.
    """
    path, files = _file_system(spark, target)
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(part) for part in parts]
    first, rest = paths[0], paths[1:]
    if rest:
        chain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(rest))
        for i, part in enumerate(rest):
            chain[i] = part
        try:
            files.concat(first, chain)
            rest = []
        except UnsupportedOperationException:
            pass
    if not rest:
        if not files.rename(first, path):
            raise OSError(f"could not rename {parts[0]} to {target}")
        return
    out = files.create(path, False)
    try:
        for part in paths:
            stream = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, _BLOCK, False)
            finally:
                stream.close()
    finally:
        out.close()


def replace_folder(spark: SparkSession, folder: str, target: str) -> None:
    """Put a folder in the place of another one."""
    path, files = _file_system(spark, target)
    files.delete(path, True)
    if not files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), path):
        raise OSError(f"could not rename {folder} to {target}")
