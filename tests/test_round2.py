"""Operators beyond SQL: the Bloom filter, alerts as a sink, containment, compressed prompts, funnel joins."""

import hashlib
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ferrule import shared
from ferrule.functions import params, text
from ferrule.operators import audit, bloom, dedup
from ferrule.sources import tables
from ferrule.streaming import alerts


def test_bloom_positions_and_rate(spark):
    assert bloom.shape() == (143_775_875, 9) and bloom.shape(1_000_000) == (14_377_587, 9)
    bits, k = bloom.shape(500, 0.01)
    keys = [f"https://example.com/{i}é" for i in range(500)] + [""]
    df = spark.createDataFrame([(x,) for x in keys], "url string")
    got = {r.url: r.p for r in df.select("url", bloom.positions(F.col("url"), bits, k).alias("p")).collect()}
    for x in keys:
        a, b = (int(h(x.encode()).hexdigest(), 16) for h in (hashlib.md5, hashlib.sha1))
        assert got[x] == [(a + i * b) % bits for i in range(k)]
    held = bloom.Bloom.of(df, "url", 500, 0.01)
    ones = {p for x in keys for p in got[x]}
    assert {i for i in range(bits) if held.data[i >> 6] >> (i & 63) & 1} == ones
    others = spark.createDataFrame([(f"other {i}",) for i in range(4000)] + [(None,)], "url string")
    assert df.where(~held.may_hold(df, "url")).count() == 0
    assert 0 < others.where(held.may_hold(others, "url")).count() < 4000 * 0.02
    with pytest.raises(ValueError):
        bloom.shape(10**10)


def test_bloom_join_is_exact(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.choice([None, *map(str, range(300))]), i) for i in range(900)], "k string, i long")
    state = spark.createDataFrame([(str(i),) for i in range(0, 300, 2)] + [(None,)], "k string")
    want = sorted(map(tuple, dedup.unseen(rows, state, "k").collect()), key=str)
    for capacity in (5, 1000):  # overfull, and as it should be
        assert sorted(map(tuple, bloom.unseen(rows, state, "k", capacity).collect()), key=str) == want
    assert bloom.unseen(rows.where("false"), state, "k").count() == 0
    assert bloom.unseen(rows, state.where("false"), "k", 100).count() == rows.count()


def test_containing_against_brute_force(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, n)))
    literals, paths = [word(14) for _ in range(150)] + [None, ""], sorted({word(7) for _ in range(25)} - {""})
    got = audit.containing(spark.createDataFrame([(x,) for x in literals], "literal string"), spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "api_path string, rank int"))
    want = {x: next(p for p in paths if p in x) for x in literals if x and any(p in x for p in paths)}
    assert {r.literal: r.api_path for r in got.collect()} == want and want


def test_limited_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 4000, 7)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    want = []
    for k in ("a", "b", None):
        last = None
        for s in sorted(s for key, s in rows if key == k and s is not None):
            if last is None or s - last >= 60:
                want.append((k, last := s))
    got = [(r.k, r.s) for r in alerts.limited(df, "k").select("k", F.unix_seconds("ts").alias("s")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert alerts.limited(df.where("false"), "k").count() == 0


def test_alert_sink(spark, tmp_path):
    rows = [("a", 0, "ERROR"), ("a", 30, "ERROR"), ("a", 61, "CRITICAL"), ("a", 62, "INFO"), ("b", 5, "ERROR")]
    spark.createDataFrame(rows, "k string, s long, level string").selectExpr("k", "timestamp_seconds(1000000 + s) AS ts", "level").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, level string").parquet(str(tmp_path / "in"))
    query = alerts.alert_sink(stream, str(tmp_path / "out"), "k").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    sent = spark.read.parquet(str(tmp_path / "out")).selectExpr("k", "unix_seconds(ts) - 1000000 AS s").collect()
    assert sorted(map(tuple, sent)) == [("a", 0), ("a", 61), ("b", 5)]


def test_prompts_show_compressed_code(spark):
    long = "function login(){ return http.post('/api/x'); }\n" + "var filler = 1; /* note */\n" * 2000
    df = spark.createDataFrame([("/api/x", long, [long, "b( );", "c", "d"]), ("/y", "f()", [])], "p string, w string, c array<string>")
    rows = df.select(params.judge_prompt(F.col("p"), F.col("w"), F.col("c")).alias("j"), params.advice_prompt(F.col("p"), F.col("w"), F.col("c"), F.array(F.lit("id"))).alias("a"), text.compress(F.col("w"), 6000).alias("k")).collect()
    assert rows[0].k in rows[0].j and rows[0].k in rows[0].a and "note" not in rows[0].j and len(rows[0].k) <= 6100
    assert "--- call 3 ---\nc" in rows[0].j and "call 4" not in rows[0].j and len(rows[0].j) < 9000
    assert rows[1].j == "API: /y\n\n[function]\nf()\n\n[calls]\n" and rows[1].a.startswith("Parameter names seen: id\n\n[function]\nf()")


def test_configuration_and_ordering(spark, tmp_path):
    (tmp_path / "models.json").write_text('[{"name": "m1",\n "rank": 1}, {"name": "m2", "rank": 0}]')
    read = lambda: {r.name: r["rank"] for r in tables.config(spark, str(tmp_path / "models.json"), "name string, rank int").collect()}
    assert read() == {"m1": 1, "m2": 0}
    (tmp_path / "models.json").write_text('{"name": "m3", "rank": 5}')
    assert read() == {"m3": 5}


def test_titles_without_a_place_stay(spark):
    html = "<!DOCTYPE html><title>A long title</title>"
    df = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://a.com/x", html), (None, "https://a.com/y", html)], "page_id long, url string, html string")
    assert sorted((r.page_id for r in dedup.distinct_titles(df).collect()), key=str) == [1, None]


def test_written_tables_go_with_the_driver(tmp_path):
    """Released at once, or when the JVM ends, even after the session has been stopped."""
    code = f"""
import sys, os
sys.path.insert(0, {str(shared.Path(shared.__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from ferrule.shared import measured, release, small, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
a, b = stored(spark.range(5), "a"), stored(spark.range(7), "b")
assert len(os.listdir({str(tmp_path)!r})) >= 2
release(a, spark.range(1))
assert not [f for f in os.listdir({str(tmp_path)!r}) if "ferrule-a" in f] and b.count() == 7 and 0 < measured(b) < 1000
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    for _ in range(50):
        left = [f for f in tmp_path.iterdir() if "ferrule" in f.name]
        if not left:
            break
        __import__("time").sleep(0.2)
    assert not left
