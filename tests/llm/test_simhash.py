import random

import numpy as np
import pyarrow as pa

from ferrule.llm import simhash as S
from ferrule.llm.components import components


def brute(f, radius=S.RADIUS):
    u = f.view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None]).sum(-1)
    i, j = np.nonzero(d <= radius)
    return {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (max(1, n // 5), 16), dtype=np.uint8)[rng.integers(0, max(1, n // 5), n)]
    flips = (rng.random((n, 128)) < rng.choice([0.0, 0.05, 0.09, 0.5], n)[:, None]).astype(np.uint8)
    return np.ascontiguousarray(base ^ np.packbits(flips, axis=1)).view(np.int64)


def test_bit_sliced_pairs_are_the_pairs():
    for n, seed in ((1, 0), (2, 1), (63, 2), (64, 3), (65, 4), (700, 5)):
        f = clustered(n, seed)
        for radius in (0, 3, 22, 40):
            i, j = S.near(f, None, radius)
            assert set(zip(i.tolist(), j.tolist())) == brute(f, radius) and len(i) == len(set(zip(i.tolist(), j.tolist())))
            first = np.arange(n) // 7 * 7
            i, j = S.near(f, first, radius)
            assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in brute(f, radius) if a // 7 == b // 7}
            i, j = S.near(f, None, radius, np.arange(0, n, 5))
            assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in brute(f, radius) if a % 5 == 0 or b % 5 == 0}


def test_fingerprints_one_by_one_as_together():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "béta", "of", "Gamma", "delta-x"]) for _ in range(rnd.choice([0, 1, 5, 400]))) for _ in range(50)] + ["long words here " * 30000]
    one = {}
    for lo, _, data, offsets in S.pieces(pa.array(texts)):
        rows, f = S.fingerprints(data, offsets)
        one |= {lo + int(r): tuple(x) for r, x in zip(rows, f.tolist())}
    for i, t in enumerate(texts):
        (_, _, data, offsets), *_ = S.pieces(pa.array([t]))
        rows, f = S.fingerprints(data, offsets)
        assert [tuple(x) for x in f.tolist()] == ([one[i]] if i in one else [])


def test_signs_are_those_of_the_weighted_sums():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["alpha", "béta", "of", "Gamma", "x", "delta", "日本語", "to"]) for _ in range(rnd.choice([1, 2, 30, 255, 256, 257, 900]))) for _ in range(40)]
    for _, _, data, offsets in S.pieces(pa.array(texts)):
        w = S.Words(data, offsets)
        rows, f = S.fingerprints(data, offsets)
        want = []
        long = w.end - w.start >= S._LONG
        words = [{(int(w.hash[i]), bool(long[i])) for i in range(a, z)} for a, z in zip(w.of, w.of[1:])]
        for k, (h, heavy, row) in enumerate(S._features(w)):
            bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).astype(np.int64)
            weight = np.where(heavy, S._WEIGHT, 1)[:, None]
            want.append([(((2 * bits - 1) * weight)[row == r].sum(0) > 0) for r in range(40)])
            if k == 0:  # each word once
                assert [sorted(zip(h[row == r, 0].tolist(), heavy[row == r].tolist())) for r in range(40)] == [sorted(x) for x in words]
        assert (np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1).astype(bool) == np.concatenate(want, axis=1)).all() and len(rows) == 40


def linked(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def frame(spark, f):
    prints = np.concatenate([f, np.zeros((len(f), 4), np.int64)], axis=1)
    return spark.createDataFrame([(i * 3, *map(int, p)) for i, p in enumerate(prints)], "id long, " + S._LONGS)


def test_every_near_pair_is_linked(spark):
    """All components of all pairs within the radius, those at the radius itself among them."""
    f = clustered(4000, 7)
    want = brute(f)
    assert linked((r.a // 3, r.b // 3) for r in S.links(frame(spark, f).repartition(5)).collect()) == linked(want)


def test_masks_miss_no_pair(monkeypatch):
    """Bits that differ in radius places agree under a mask; joined by masks, components are those of all pairs."""
    rng = np.random.default_rng(10)
    for radius in (0, 1, 2, 3, 7, 22, 23):
        chosen = list(S.masks(radius))
        for _ in range(300):
            apart = np.zeros(128, np.uint8)
            apart[rng.permutation(128)[:radius]] = 1
            quarters = np.packbits(apart).view(np.uint32)
            assert any(quarters[quarter] & mask == 0 for quarter, mask in chosen)
    monkeypatch.setattr(S, "FEW", 0)
    monkeypatch.setattr(S, "_PAIRS", 500)
    monkeypatch.setattr(S, "_HELD", -1000)
    for n, seed in ((0, 0), (1, 0), (2, 1), (65, 4), (1500, 5)):
        f = clustered(n, seed) if n else np.zeros((0, 2), np.int64)
        prints = np.concatenate([f, rng.integers(0, 2, (n, 4))], axis=1)
        for radius, pair_radius in ((0, 4), (3, 4), (22, 4), (22, 1), (23, 4), (40, 4)):
            i, j = np.array(sorted(brute(f, radius)), np.int64).reshape(-1, 2).T if n else np.zeros((2, 0), np.int64)
            close = (prints[i, 2:] != prints[j, 2:]).sum(1) <= pair_radius
            assert (S.roots(n, *S.tied(prints, radius, pair_radius)) == S.roots(n, i[close], j[close])).all()


def test_a_hot_bucket_loses_nothing(spark, monkeypatch):
    """However the rows are cut into cells, and joined in them, the components are those of all pairs."""
    f = np.concatenate([clustered(900, 8), clustered(1, 9) ^ (np.int64(1) << np.random.default_rng(2).integers(0, 60, (400, 2)))])
    f = f[np.random.default_rng(3).permutation(len(f))]
    df = frame(spark, f).repartition(5)
    whole = linked((3 * a, 3 * b) for a, b in brute(f))
    for cell, few in ((100, 2048), (60, 0), (300, 50), (2000, 0)):
        monkeypatch.setattr(S, "CELL", cell)
        monkeypatch.setattr(S, "FEW", few)
        assert linked((r.a, r.b) for r in S.links(df).collect()) == whole


def test_scripts_without_spaces(spark):
    """Near copies in Chinese and Japanese are found, other texts of the same characters aren't."""
    rnd = random.Random(5)
    common = [chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(700)]
    docs, want = [], set()
    for g in range(30):
        base = [rnd.choice(common) for _ in range(1500)]
        for c in range(2):
            text = list(base)
            for k in rnd.sample(range(1500), 15 * c):
                text[k] = rnd.choice(common)
            docs.append((len(docs), "。".join(["".join(text[:700]), "".join(text[700:])])))
        want.add((2 * g + 1, 2 * g))
    assert {tuple(r) for r in S.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def words(rnd, n):
    return [rnd.choice("aeiou") + "".join(rnd.choice("bcdfglmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n)]


def test_groups(spark, monkeypatch):
    rnd = random.Random(2)
    docs, want = [], {}
    for g in range(40):
        base = words(rnd, 120)
        for c in range(rnd.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(2 * c):
                text[rnd.randrange(120)] = words(rnd, 1)[0]
            docs.append((len(docs), " ".join(text), g))
            want.setdefault(g, []).append(len(docs) - 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, keep_id int")
    answer = {(d, min(g)) for g in want.values() for d in g if d != min(g)}
    assert {tuple(r) for r in S.near_groups(df).collect()} == answer
    kept = S.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want.values())
    monkeypatch.setattr(S, "CELL", 10)  # many cells
    monkeypatch.setattr(S, "FEW", 0)
    assert {tuple(r) for r in S.near_groups(df).collect()} == answer


def test_shared_vocabulary_is_no_copy(spark):
    """Texts of the same words in other orders are near by their words, but not by their pairs of words."""
    rnd = random.Random(3)
    common = words(rnd, 150)
    docs = [(i, " ".join(rnd.sample(common, 150))) for i in range(30)] + [(100 + i, " ".join(common[:-i] + words(rnd, i))) for i in range(1, 4)]
    assert {tuple(r) for r in S.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {(102, 101), (103, 101)}


def test_edges(spark):
    schema = "doc_id long, text string, __gone string, f0 string"
    rows = [(1, None, "a", "b"), (None, "some words here", "a", "b"), (2, "", "a", "b"), (3, "?!", "a", "b"), (4, "Some words, here", None, None), (4, "Some words, here", None, None), (5, "some words here", "x", "y"), (9, "other " * 100000, "x", "y")]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in S.near_groups(df).collect()] == [(5, 4)]
    assert sorted(map(str, S.near_dedup(df).collect())) == sorted(map(str, df.where("coalesce(doc_id, 0) <> 5").collect()))
    assert S.near_groups(df.where("false")).count() == 0 and S.near_dedup(df.where("false")).count() == 0


def test_a_chain_in_one_bucket(spark, monkeypatch):
    """A chain without chords, in ten bits that the former tables didn't sample: its links between parts of a hot bucket count,
    also of rows that hang on different pivots."""
    path = [0]

    def grow():
        if len(path) == 60:
            return True
        for bit in range(10):
            at = path[-1] ^ 1 << bit
            if all((at ^ p).bit_count() > 1 for p in path[:-1]) and at != path[-1]:
                path.append(at)
                if grow():
                    return True
                path.pop()
        return False

    assert grow()
    bits = np.zeros((60, 128), np.uint8)
    bits[:, [0, 4, 32, 66, 67, 110, 112, 113, 114, 115]] = np.array(path)[:, None] >> np.arange(10) & 1
    f = np.packbits(bits, axis=1).view(np.int64)
    assert len(brute(f, 1)) == 59
    for name, value in (("CELL", 20), ("SAMPLE", 1), ("PIVOTS", 15)):  # the last two of the former code
        monkeypatch.setattr(S, name, value, raising=False)
    ids = np.random.default_rng(0).permutation(1000)[:60]
    df = frame(spark, f).join(spark.createDataFrame([(3 * i, int(x)) for i, x in enumerate(ids)], "id long, new long"), "id").withColumn("id", S.F.col("new")).drop("new")
    assert set(linked((r.a, r.b) for r in S.links(df, 1).collect()).values()) == {min(ids)} and S.links(df, 1).selectExpr("a AS x").union(S.links(df, 1).selectExpr("b")).distinct().count() == 60
