"""Exact dedup by skew-safe combining.

Copies are first combined within each map task, then by (digest, salt), where the salt spreads a hot text over
many reducers, then the salts' winners by digest. The full text is a grouping key at each of the three steps, so a
digest that two texts share never joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Reducers that a hot text is spread over.
SALTS = 64


def comparable(kind: T.DataType) -> bool:
    """Whether values of a type have an order; those with a map or a variant anywhere within have none."""
    if isinstance(kind, T.ArrayType):
        return comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def winners(docs: DataFrame, keep: list[str], salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: __text, __copies, and __w with __id and the columns of keep (named _0, _1, ...)."""
    digest = F.xxhash64("text")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(salts)).cast("int")
    names = [f"_{i}" for i in range(len(keep))]
    has_order = [comparable(docs.schema[c].dataType) for c in keep]
    # the lowest doc_id, nulls last, then the lowest other values; a value without an order is compared by its text
    order = [F.col("doc_id").isNull().alias("__null"), F.col("doc_id").alias("__id")]
    order += [(F.col(f"`{c}`") if plain else F.to_json(F.struct(F.col(f"`{c}`")))).alias(n if plain else f"{n}_text") for c, n, plain in zip(keep, names, has_order)]
    rest = [F.col(f"`{c}`").alias(n) for c, n, plain in zip(keep, names, has_order) if not plain]
    rows = docs.where("text IS NOT NULL").select(digest.alias("__digest"), salt.alias("__salt"), F.col("text").alias("__text"), F.struct(*order).alias("__w"), *([F.struct(*rest).alias("__r")] if rest else []))

    def lowest() -> list[Column]:
        return [F.min("__w").alias("__w")] + ([F.min_by("__r", "__w").alias("__r")] if rest else [])

    salted = rows.groupBy("__digest", "__salt", "__text").agg(*lowest(), F.count(F.lit(1)).alias("__copies"))
    won = salted.groupBy("__digest", "__text").agg(*lowest(), F.sum("__copies").alias("__copies"))
    both = F.struct(F.col("__w.__id").alias("__id"), *[F.col(f"__w.{n}" if plain else f"__r.{n}").alias(n) for n, plain in zip(names, has_order)])
    return won.select("__digest", "__text", both.alias("__w"), "__copies")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without its copies: of the rows with one text that with the lowest doc_id stays, all columns as they were.

    Rows with a null text are no copies of each other and all stay. Empty texts are copies of each other. Among rows
    with one text and one doc_id (repeated rows) the lowest of the other columns' values, in order, stay; values that
    hold a map or a variant are compared by their JSON. A null doc_id comes after all others. An empty table gives an
    empty table; further columns, whatever their names, pass.
    """
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    won = winners(docs, keep, salts)
    back = {"doc_id": F.col("__w.__id"), "text": F.col("__text")} | {c: F.col(f"__w._{i}") for i, c in enumerate(keep)}
    kept = won.select(*[back[c].alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("text IS NULL"))


def exact_dedup_ids(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id and the number of copies for each document that exact_dedup keeps."""
    won = winners(docs.select("doc_id", "text"), [], salts).select(F.col("__w.__id").alias("doc_id"), F.col("__copies").alias("copies"))
    return won.unionByName(docs.where("text IS NULL").select("doc_id", F.lit(1).cast("bigint").alias("copies")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_ids(read(spark, sf_dir, "documents"))


SQL = """
SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, CAST(1 AS BIGINT) AS copies FROM documents WHERE text IS NULL
"""
