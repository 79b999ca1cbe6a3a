import random

from ferrule.llm import sharding as S


def brute(rows, shards):
    total = sum(n for _, n in rows)
    order = lambda k: -1 << 70 if k is None else k
    return {k: 0 if k is None or not total else min(shards - 1, sum(n for j, n in rows if order(j) < order(k)) * shards // total) for k, _ in rows}


def test_exact_splitters(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, rnd.randrange(50), rnd.randrange(-(2**60), 2**60)]), "é" * rnd.randrange(30) if rnd.random() < 0.9 else None) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, shard int").repartition(5)
    want = brute([(k, 2 * len(t or "")) for k, t in rows], 7)
    out = S.histogram_sort(docs, 7)
    assert out.columns == ["doc_id", "text", "shard", "shard_"] and out.rdd.getNumPartitions() == 7
    got = out.collect()
    assert sorted(r["shard"] for r in got) == list(range(400))
    assert all(r["shard_"] == want[r["doc_id"]] for r in got)
    for part in out.rdd.glom().collect():
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in part]
        assert keys == sorted(keys)


def test_tolerance_saves_rounds(spark):
    light = spark.range(20000).selectExpr("id * 1000003 AS key", "id % 90 AS bytes").cache()
    exact, many = S.splitters(light, 16)
    near, fewer = S.splitters(light, 16, tolerance=0.05)
    assert fewer <= many
    total = light.agg({"bytes": "sum"}).first()[0]
    for i, (a, b) in enumerate(zip(exact, near), 1):
        below = light.where(f"key < {b}").agg({"bytes": "sum"}).first()[0]
        assert abs(below - total * i / 16) <= 0.05 * total / 16 + 1
        assert light.where(f"key < {a}").agg({"bytes": "sum"}).first()[0] >= total * i / 16


def test_edges(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert S.histogram_sort(empty, 4).count() == 0
    same = S.histogram_sort(spark.createDataFrame([(5, "x")] * 9, schema), 4).collect()
    assert {r.shard for r in same} == {0} and len(same) == 9
    none = S.histogram_sort(spark.createDataFrame([(1, None), (None, None), (2, "")], schema), 4).collect()
    assert {r.shard for r in none} == {0}
    ends = S.histogram_sort(spark.createDataFrame([(2**63 - 1, "a" * 100000), (-(2**63), "b")], schema), 2).collect()
    assert len(ends) == 2
