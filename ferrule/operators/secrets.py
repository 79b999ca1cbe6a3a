"""Literals that may be secrets. The design is this library's own: rules take literals away, a score ranks the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules

LITERAL = r"""["']([^"'\n]{6,})["']"""
PER_SCRIPT = 50


def entropy(text: Column) -> Column:
    """Bits for each character by the text's own frequencies; 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = F.array_distinct(F.split(text, ""))
    bits = lambda c: F.length(F.replace(text, c, F.lit("")))
    share = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (n - bits(c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def score(value: Column, telling: Column) -> Column:
    """0 to 1: entropy, mixed kinds of characters and a telling word on the line speak for a secret, technical words against."""
    kinds = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    raw = 0.12 * entropy(value) + 0.1 * kinds + F.when(telling, 0.2).otherwise(0.0) - F.when(rules.holds(F.lower(value), rules.TECHNICAL_WORDS), 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def literals(texts: DataFrame, key: str, text: str, per_script: int = PER_SCRIPT) -> DataFrame:
    """key, value and score of the per_script highest-scored distinct literals of each text (a top-k report).

    Texts and literals may be of any length. Only whether a line is telling goes along with its literals, not the line.
    """
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(LITERAL) & ~rules.holds(F.col("line"), rules.HARMLESS_CODE))
    lines = lines.select(key, rules.holds(F.lower("line"), rules.SECRET_WORDS).alias("telling"), F.regexp_extract_all("line", F.lit(LITERAL), F.lit(1)).alias("values"))
    found = lines.select(key, "telling", F.explode("values").alias("value"))
    v = F.col("value")
    plain = v.isin(*rules.PLAIN_VALUES, ".", "/") | rules.holds(v, rules.NOT_SECRET) | F.contains(v, F.lit(" ")) | ~v.rlike("[a-zA-Z0-9]")
    best = found.where(~plain).groupBy(key, "value").agg(F.max(score(v, F.col("telling"))).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "value")
    return best.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_script).drop("__n")
