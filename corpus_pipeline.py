"""From raw documents to packed windows: toxicity, exact copies, near copies, benchmark passages, packing.

Every stage takes whole rows and returns whole rows; all but the last keep the columns of docs, whatever others stand
beside doc_id, text and source. A null text passes all filters (it is no copy, has no words and no passage) and stands
in no window; so does an empty one, of which one row stays. A null doc_id is scored, compared as an exact copy and
searched for passages, but is no near copy. Of rows equal in every value one stays. An empty table stays empty at
every stage, and the windows are then none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.common import read, release, stored
from ferrule.llm.decontaminate import decontaminate
from ferrule.llm.exact_dedup import exact_dedup
from ferrule.llm.mixture import pack_mixture
from ferrule.llm.simhash import near_dedup
from ferrule.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to docs and the labels table, doesn't find toxic; all if nothing is labelled toxic."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text the row with the lowest doc_id, nulls last, then the lowest other values; every row without a text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the lowest doc_id; every row without a doc_id or a word."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark table; all if that is empty."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows filled from the sources, a null one among them, in their target proportions."""
    return pack_mixture(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: Classifier, fingerprints, alignments and token counts are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what is read goes once the next is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
