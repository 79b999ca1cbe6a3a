"""The pipeline against a brute-force version: each stage's decisions by plain loops over its own input."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from ferrule.llm import decontaminate as D
from ferrule.llm import simhash as S
from ferrule.llm import token_counts as C
from ferrule.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, __gone int"
BAD = ["vexgrim", "zolkrat", "murfblag", "skrondel"]


def words(rnd, n):
    return [rnd.choice("aeiou") + "".join(rnd.choice("bcdfglmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, leaked passages, nulls, empty and repeated rows, and clashing columns."""
    rnd = random.Random(11)
    docs, toxic, near, leaks = [], set(), {}, set()
    items = [(i, " ".join(words(rnd, 15))) for i in range(4)]

    def add(text, source=None):
        docs.append((len(docs), text, "en", source or rnd.choice(["hot", "hot", "hot", "a", None]), len(text or ""), "t", 1))
        return len(docs) - 1

    for i in range(260):
        text = words(rnd, 90)
        if i % 5 == 0:
            for k in range(0, 90, 9):
                text[k] = rnd.choice(BAD)
            toxic.add(add(" ".join(text)))
        elif i % 11 == 1:
            a = add(" ".join(text))
            text[40], text[70] = words(rnd, 2)
            near[add(" ".join(text))] = a
        elif i % 13 == 2:
            text[30:30] = items[i % 4][1].upper().split()
            leaks.add(add(" ".join(text)))
        else:
            add(" ".join(text))
            if i % 7 == 3:
                add(" ".join(text))
    add(None)
    add(None)
    add("")
    add("")
    add("long " * 30_000 + " ".join(words(rnd, 50)))
    docs += [docs[1], docs[1], (None, docs[2][1], "en", "a", 1, "t", 1), (None, " ".join(words(rnd, 60)), "en", None, 1, "t", 1)]
    rnd.shuffle(docs)
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (None, "x"), (9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic, near, leaks, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def jaccard(a, b):
    a, b = (set(zip(w, w[1:])) or {tuple(w)} for w in (re.findall(r"\w+", x.lower()) for x in (a, b)))
    return len(a & b) / len(a | b)


def test_stages_against_brute_force(spark, made):
    folder, docs, toxic, near, leaks, items = made
    table = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    stages = dict(P.STAGES)
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    # toxicity: what the model, applied text by text, gives; the planted ones go and clean ones stay
    model = T.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [d for d in docs if d[1] is None or T.logits(pa.array([d[1]]), *model)[0] <= 0]
    out = stages["toxicity"](spark, table, folder)
    assert out.columns == table.columns and rows(out) == sorted(left, key=str)
    gone = {d[0] for d in docs} - {d[0] for d in left}
    assert gone <= toxic and len(gone) >= 0.85 * len(toxic)  # fitted to 200 labels

    # exact copies: the lowest doc_id of each text, nulls last
    best = {}
    for d in left:
        if d[1] is not None and (d[1] not in best or (d[0] is None, d[0] or 0) < (best[d[1]][0] is None, best[d[1]][0] or 0)):
            best[d[1]] = d
    left = [*best.values(), *(d for d in left if d[1] is None)]
    out = stages["exact_dedup"](spark, spark.createDataFrame(left, SCHEMA).unionByName(spark.createDataFrame(left[:50], SCHEMA).where("text IS NOT NULL")), folder)
    assert out.columns == table.columns and rows(out) == sorted(left, key=str)

    # near copies: all pairs of texts by their word pairs
    texts = [d for d in left if d[0] is not None and d[1]]
    copies = {max(a[0], b[0]) for i, a in enumerate(texts) for b in texts[:i] if jaccard(a[1], b[1]) > 0.7}
    assert copies == set(near)
    left = [d for d in left if d[0] not in copies]
    out = stages["near_dedup"](spark, spark.createDataFrame([*left, *(d for d in docs if d[0] in copies)], SCHEMA), folder)
    assert out.columns == table.columns and rows(out) == sorted(left, key=str)

    # passages: every item at every place
    plain = lambda t: "".join(re.findall(r"\w", t.lower()))
    gone = {d[0] for d in left if d[1] and any(plain(t) in plain(d[1]) for _, t in items)}
    assert gone == leaks
    out = stages["decontamination"](spark, spark.createDataFrame(left, SCHEMA), folder)
    left = [d for d in left if d[0] not in gone]
    assert out.columns == table.columns and rows(out) == sorted(left, key=str)

    # the windows hold just these documents, in whole
    with open(C.VOCABULARY, "rb") as f:
        enc = C.encoding(f.read())
    want = sorted((str(d[0]), str(d[3]), len(enc.encode_ordinary(d[1]))) for d in left if d[1])
    windows = P.run(spark, folder).collect()
    sizes = {}
    for w in windows:
        for doc, source, n in zip(w["doc_ids"], w["sources"], w["lengths"]):
            sizes[str(doc), str(source)] = sizes.get((str(doc), str(source)), 0) + n
    assert sorted((*k, n) for k, n in sizes.items()) == want
    assert all(w["tokens"] == 8192 for w in windows[:-1]) and P.ORACLE_SQL is None


def test_empty_tables(spark, made, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{made[0]}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert P.run(spark, folder).count() == 0
    some = spark.read.parquet(f"{made[0]}/documents.parquet").where("doc_id < 5 OR text IS NULL")
    some.write.parquet(f"{folder}/some.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, some.where("false"), folder).count() == 0
        if name in ("toxicity", "decontamination"):
            assert rows(stage(spark, some, folder)) == rows(some)
    assert os.listdir(folder)
    assert D.Q == 8


def test_near_stage_links_every_pair(spark, made):
    """Chains of edits at about the radius: what stays is the lowest of each component of all pairs of fingerprints."""
    rnd = random.Random(8)
    texts = []
    for _ in range(25):
        text = words(rnd, 150)
        for _ in range(30):
            for k in rnd.sample(range(150), 11):
                text[k] = words(rnd, 1)[0]
            texts.append(" ".join(text))
    (_, _, data, offsets), *more = S.pieces(pa.array(texts))
    _, f = S.fingerprints(data, offsets)
    assert not more and len(f) == len(texts)
    root = list(range(len(f)))
    u = f.view("uint64")
    for i in range(len(f)):
        apart = np.bitwise_count(u ^ u[i])
        for j in np.flatnonzero((apart[:, :2].sum(1) <= S.RADIUS) & (apart[:, 2:].sum(1) <= S.PAIR_RADIUS)):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, None, "s", len(t), None, None) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, docs, made[0]).collect()) == sorted(set(root)) and len(set(root)) < len(f) / 2
