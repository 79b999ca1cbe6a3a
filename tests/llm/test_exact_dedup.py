import random

from ferrule.llm import exact_dedup as E


def brute(rows):
    """Of each text the row with the lowest doc_id, nulls last, then the lowest other values."""
    order = lambda r: (r[0] is None, r[0] or 0, *[(x is not None, x or "") for x in r[2:]])
    best = {}
    for r in rows:
        if r[1] is not None and (r[1] not in best or order(r) < order(best[r[1]])):
            best[r[1]] = r
    return sorted([*best.values(), *(r for r in rows if r[1] is None)], key=str)


SCHEMA = "doc_id long, text string, __digest string, __salt string"


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", "a", "A", "a ", "é", "hot", "x" * 300_000, None]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([*texts, "hot", "hot", str(rnd.randrange(60))]), rnd.choice([None, "p", "q"]), "z") for _ in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for salts in (1, 64):
        out = E.exact_dedup(df, salts)
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == brute(rows)
    ids = E.exact_dedup_ids(df)
    n = {t: sum(r[1] == t for r in rows) for _, t, *_ in rows}
    assert sorted(map(tuple, ids.collect()), key=str) == sorted(((r[0], 1 if r[1] is None else n[r[1]]) for r in brute(rows)), key=str)


def test_equal_digests_dont_join_texts(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *_: E.F.lit(1).cast("long"))
    rows = [(i, t, None, None) for i, t in enumerate(["a", "b", "a", "c", "b"])]
    assert sorted(r.doc_id for r in E.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 3]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "x", "y")], SCHEMA)
    assert E.exact_dedup(df.where("false")).count() == 0 and E.exact_dedup_ids(df.where("false")).count() == 0


def test_values_without_an_order(spark):
    """Maps and variants anywhere in a column pass as they are; between repeated rows their JSON decides."""
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "a", 0), (3, "b", 5), (4, None, 6)], "doc_id long, text string, k int")
    df = rows.selectExpr("doc_id", "text", "map('k', k) AS m", "array(map(k, k)) AS am", "named_struct('x', map('y', k)) AS sm", "parse_json(string(k)) AS v", "k AS __r")
    out = E.exact_dedup(df)
    assert out.dtypes == df.dtypes
    got = out.selectExpr("doc_id", "text", "m['k'] AS m", "am[0] AS am", "sm.x AS sm", "string(v) AS v", "__r").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 1, {1: 1}, {"y": 1}, "1", 1), (3, "b", 5, {5: 5}, {"y": 5}, "5", 5), (4, None, 6, {6: 6}, {"y": 6}, "6", 6)]
    assert E.exact_dedup(df.where("false")).count() == 0
