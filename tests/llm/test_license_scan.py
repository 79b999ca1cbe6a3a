import random
import re

from ferrule.llm import license_scan as L


def words(text):
    return re.findall(r"[a-z0-9\u0080-￿]+", text.lower())


def fewest(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_finds_what_brute_force_finds(spark):
    rnd = random.Random(8)
    vocabulary = sorted({w for t in L.TEMPLATES.values() for w in words(t)}) + ["lorem", "ipsum"] * 40
    docs = []
    for d in range(80):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(d % 3):
            t = rnd.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rnd.randint(0, 1 + len(t) // 5)):
                k = rnd.randrange(len(t))
                t[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
            k = rnd.randint(0, len(text))
            text[k:k] = [w.upper() for w in t] if rnd.random() < 0.3 else t
        docs.append((d, " ".join(text)))
    want = set()
    for d, text in docs:
        for name, t in L.TEMPLATES.items():
            t = words(t)
            if fewest(t, words(text)) <= L.budget(len(t), L.RATE)[0]:
                want.add((d, name))
    got = L.license_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(want) > 40
    text = dict(docs)
    for r in got:
        assert fewest(words(L.TEMPLATES[r.license]), words(text[r.doc_id])[r.start : r.end]) == r.edits


def test_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, None, 0), (None, line, 0), (2, "", 0), (3, "word " * 50000 + line, 0), (4, f"{line} " * 40, 0), (5, line, 0), (5, line, 0), (6, "under the MIT", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = sorted(map(tuple, L.license_spans(df).collect()), key=str)
    want = [(None, "MIT notice", 0, 5, 0), (3, "MIT notice", 50000, 50005, 0)] + [(4, "MIT notice", 5 * i, 5 * i + 5, 0) for i in range(40)] + [(5, "MIT notice", 0, 5, 0)] * 2
    assert got == sorted(want, key=str)
    assert L.license_spans(df.where("false")).count() == 0
    assert L.license_spans(df, {}).count() == 0 and L.license_spans(df, {"short": "two words"}).count() == 0
