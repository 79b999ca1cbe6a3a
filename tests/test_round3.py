"""The structural cut in built-ins: as the loop in Python cuts, with no Python worker and in time that grows as the text does."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ferrule.functions import text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ATOMS = ["function", "async", "a", "é_", "漢", "𠀀", "\u2c2f", "\U00031350", "²", "👍", "=", ":", " ", "\n", "\x1c", "\x85", "　", "\0", "\1", "get", "token", "(", "{", "$", "\\", "function f", "x = function", "y:async function", "post();"]


@pytest.mark.parametrize("name", ["code_compress", "structural_truncate", "judge_prompts"])
def test_no_text_goes_to_a_python_worker(spark, name):
    assert "Python" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1, 10, 37, 200, 1000])
def test_cut_against_the_loop(spark, limit):
    rnd = random.Random(limit)
    texts = [None, "", "x" * limit, "x" * (limit + 1)]
    for _ in range(600):
        some = rnd.sample(ATOMS, rnd.randint(2, len(ATOMS)))
        texts.append("".join(rnd.choice(some) for _ in range(rnd.randint(0, limit + 8))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.structural_truncate(F.col("t"), limit).alias("c")).collect()}
    want = {i: None if t is None else text.truncated(t, limit) for i, t in enumerate(texts)}
    assert got == want and any(c != t and c.endswith(text.CUT_KEPT) for t, c in zip(texts, want.values()) if t)


def test_words_and_gaps_of_any_length(spark):
    n = 1 << 20
    df = spark.range(1).select(F.expr(f"repeat('a', {n})").alias("word"), F.expr(f"concat('a', repeat(' ', {n}), '=function get')").alias("gap"))
    got = df.select(*[text.structural_truncate(F.col(c), 50).alias(c) for c in df.columns]).first()
    assert got.word == "a" * 50 + text.CUT and got.gap == "a" + " " * 49 + text.CUT_KEPT
