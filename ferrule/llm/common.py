"""Reading tables, Arrow batches of bounded size, and joins whose small side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import BROADCAST_BYTES, measured, release, small, stored  # noqa: F401  (the operators take them from here)

#: Bytes of an Arrow batch at most (a longer row is one of its own), unless the session says otherwise; a worker holds several copies of one.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, and hold batches of text to BATCH_BYTES where the user has set no size."""
    shared.ship(spark)
    unset = f"{BATCH_BYTES + 1}b"  # what is answered where nothing is set
    if spark.conf.get(_BATCH, unset) == unset:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many _ behind it as it takes to differ from all taken ones."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids(doc_id), a written table; those with a null id stay."""
    name = fresh("__gone", docs.columns)
    gone = small(ids.select(F.col("doc_id").alias(name)))
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
