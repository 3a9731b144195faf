"""Tables and files kept where every executor reaches them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What this process has settled, by application, for ``release``.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one below the warehouse.

    Without the setting, a warehouse on a machine's own disk serves a session whose
    tasks run in the driver; any other session is refused, as its executors would
    not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        one_machine = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        if not one_machine and re.match(r"(file:)?/", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{warehouse}/_shared"
    return named.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, so that every reader opens the same one."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", files.makeQualified(target).toString())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, remembered for ``release``."""
    folder = f"{qualified(spark, shared_folder(spark))}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


@dataclass(frozen=True)
class Settled:
    """A table written to the shared folder, and how many rows it has."""

    table: DataFrame
    rows: int


def settled(df: DataFrame) -> Settled:
    """Compute ``df`` once, whatever is built on it, and count it on the way.

    Later steps read the written rows, column by column, so several of them do not
    repeat the scan below, and a lost executor does not either.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.option("compression", "zstd").parquet(path)
    return Settled(spark.read.schema(df.schema).parquet(path), seen.get["rows"])


def release(spark: SparkSession, kept: int = 0) -> int:
    """Delete what ``settled`` and ``new_path`` have laid down in this application.

    Call it once the results that were built on those tables are written. The first
    ``kept`` folders stay. Returns the number of folders deleted.
    """
    folders = _written.get(spark.sparkContext.applicationId, [])
    gone, folders[kept:] = folders[kept:], []
    for folder in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(path, True)
    return len(gone)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was laid down inside, and nothing from before."""
    kept = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, kept)


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file through the file system that ``path`` names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(content)
    finally:
        out.close()
