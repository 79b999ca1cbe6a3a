"""First, last and best rows by key, and anti-joins against state.

Each keep_* is one aggregation with partial results on the map side (min_by and max_by of a struct), not a window:
no partition is sorted, and a hot key is combined before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, urls
from ..functions.text import status_priority


def _pick(df: DataFrame, keys: list[str], order: list[Column], best: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("__one"))
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    kept = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg((F.max_by if best else F.min_by)(row, by).alias("__row"))
    return kept.select(*[F.col(f"`{c}`") if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is lowest in order (nulls lowest); all columns as they were."""
    return _pick(df, keys, [F.col(f"`{c}`") for c in order], False)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is highest in order."""
    return _pick(df, keys, [F.col(f"`{c}`") for c in order], True)


def best_response(responses: DataFrame, key: str = "url", status: str = "status_code", seq: str = "seq") -> DataFrame:
    """The response of each URL with the highest status priority, the earliest of equals, with the number of others."""
    one = responses.withColumn("__rank", F.struct(status_priority(F.col(status)).alias("p"), (-F.col(seq)).alias("s")))
    rest = [c for c in responses.columns if c != key]
    kept = one.groupBy(key).agg(F.max_by(F.struct(*rest), "__rank").alias("__row"), (F.count("*") - 1).alias("duplicates"))
    return kept.select(key, *[F.col("__row")[c].alias(c) for c in rest], "duplicates")


def distinct_titles(pages: DataFrame, url: str = "url", html: str = "html", order: str = "page_id") -> DataFrame:
    """pages without those whose host and title an earlier one has. Scripts, short titles and such (may_repeat) all stay."""
    title = F.lower(F.trim(extract.title(F.col(html))))
    marked = pages.withColumns({"__host": urls.netloc(F.col(url)), "__title": title, "__compared": extract.may_repeat(F.col(url), F.col(html), title)})
    first = marked.where("__compared").groupBy("__host", "__title").agg(F.min(order).alias("__first"))
    kept = first.select("__first")
    compared = marked.where("__compared").select(*pages.columns)
    unnamed = compared.where(F.col(order).isNull())  # what has no place in the order is later than none
    return compared.join(kept, F.col(order) == F.col("__first"), "left_semi").unionByName(unnamed).unionByName(marked.where("NOT __compared").select(*pages.columns))


def unseen(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't in state; bloom.unseen does the same where most keys are new."""
    return df.join(state.select(F.col(key).alias("__seen")), F.col(key) == F.col("__seen"), "left_anti")


def new_keys(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """The distinct keys of df that are to be added to state (insert or ignore)."""
    return unseen(df.select(key).where(F.col(key).isNotNull()).distinct(), state, key)
