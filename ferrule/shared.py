"""The folder that all executors share, written tables in it, and sides of joins whose size is measured."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a measured side is broadcast.
BROADCAST_BYTES = 32 << 20
_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once in a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ferrule-code-")  # on the driver: Spark's file server hands it out
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(archive := os.path.join(folder, "ferrule-code.zip"), "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without it has a folder of its own, any other is refused."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = made = tempfile.mkdtemp(prefix="ferrule-")
        atexit.register(shutil.rmtree, made, True)
    return _own[context.applicationId]


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, and no executor holds it.

    release() deletes it; what isn't released goes when the driver's JVM ends, also after the session has been stopped.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/ferrule-{name}-{uuid.uuid4().hex}"
    files, at = _at(spark, path)
    files.mkdirs(at)  # what isn't there can't be marked
    files.deleteOnExit(at)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := table.__dict__.get("_ferrule_path"):
            files, at = _at(table.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def measured(df: DataFrame) -> int:
    """A bound of the bytes that a written table takes in memory: each row by its values' text, twice, and 16 bytes a column."""
    if not df.columns:
        return 0
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return int(df.agg(F.sum(2 * row + 16 * (len(df.columns) + 2))).first()[0] or 0)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, with a broadcast hint if it takes at most limit bytes; else Spark's shuffle joins apply."""
    return F.broadcast(df) if measured(df) <= limit else df.hint("merge")
