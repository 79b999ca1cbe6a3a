"""Non-negative positive-unlabelled learning: held-out accuracy, the estimator itself, and edge cases."""

import random

import numpy as np
import pyarrow as pa

from ferrule.llm import toxicity as T


def corpus(seed, n, share=0.15):
    rnd = random.Random(seed)
    clean = [f"{a}{b}" for a in ("mor", "tal", "ven", "sul", "pir") for b in ("an", "ed", "ist", "ow", "uk", "el")]
    bad = ["vexgrim", "zolkrat", "murfblag", "skrondel"]
    rows = []
    for i in range(n):
        toxic = rnd.random() < share
        words = [rnd.choice(clean) for _ in range(rnd.randint(20, 200))]
        if toxic:
            for _ in range(max(1, len(words) // 12)):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", "s", "ing"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 2400)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[:1200]], "doc_id long, toxic int")
    out = T.scored(docs, labels)
    assert out.columns == ["doc_id", "text", "toxicity", "toxicity_"]
    score = {r.doc_id: r.toxicity_ for r in out.collect()}
    held = rows[1200:]
    hit = [score[i] > 0.5 for i, _, x in held if x]
    false = [score[i] > 0.5 for i, _, x in held if not x]
    assert np.mean(hit) > 0.95 and np.mean(false) < 0.01
    flagged = {r.doc_id for r in T.toxic_ids(docs, labels).collect()}
    assert flagged == {i for i, s in score.items() if s > 0.5}
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(score) - flagged


def test_the_unlabelled_are_documents_of_any_kind(spark):
    """Half of the documents bear no label at all; of the labels only which are toxic counts, and the prior."""
    rows = corpus(2, 800)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[:400]], "doc_id long, toxic int")
    prior = sum(x for *_, x in rows[:400]) / 400
    taken = T.sample(docs, labels, 1000, 300).collect()
    assert {r.id for r in taken if r.toxic} == {i for i, _, x in rows[:400] if x}
    free = [r.id for r in taken if not r.toxic]
    assert len(free) == len(set(free)) == 300 and sum(i >= 400 for i in free) > 100
    w, b = T.train(docs, labels)
    w2, b2 = T.train(docs, labels.where("toxic = 1"), prior=prior)
    assert np.allclose(w, w2) and abs(b - b2) < 1e-9


def test_the_sample_is_bounded(spark):
    """Repeated documents count once, and long ones only while their features fit."""
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    w, b = T.train(docs, labels)
    w2, b2 = T.train(docs.unionByName(docs).unionByName(docs), labels)
    assert np.allclose(w, w2) and abs(b - b2) < 1e-9
    assert T.train(docs, labels, max_features=10) is None
    assert not np.allclose(T.train(docs, labels, max_features=4000)[0], w)


def vectors_of(rnd, n, shift, size=40):
    out = []
    for _ in range(n):
        f = np.unique(rnd.integers(0, size, 12)) + shift
        out.append((f.astype(np.int32).tobytes(), rnd.random(len(f)).astype(np.float32).tobytes()))
    return out


def test_risk_against_dense_sums_and_finite_differences():
    rnd = np.random.default_rng(0)
    toxic, free, prior = vectors_of(rnd, 30, 0), vectors_of(rnd, 50, 10), 0.3
    used = np.arange(3, 45, dtype=np.int32)
    p, u = T.Rows(toxic, used), T.Rows(free, used)

    def dense(found):
        x = np.zeros((len(found), 1 << 6))
        for i, (f, v) in enumerate(found):
            x[i, np.frombuffer(f, np.int32)] = np.frombuffer(v, np.float32)
        return x[:, used]

    def by_hand(w):
        zp, zu = dense(toxic) @ w[:-1] + w[-1], dense(free) @ w[:-1] + w[-1]
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    w = rnd.normal(size=len(used) + 1)
    positive, clean, of_positive, of_clean = T.risk(p, u, prior, w)
    assert np.allclose((positive, clean), by_hand(w))
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-5
        slope = (np.array(by_hand(w + step)) - by_hand(w - step)) / 2e-5
        assert np.allclose((of_positive[i], of_clean[i]), slope, atol=1e-6)


def test_risk_does_not_go_below_zero():
    """Toxic and unlabelled rows of one kind and a prior that is too high: plain risk minimising would drive the clean part down."""
    rnd = np.random.default_rng(0)
    toxic, free, prior = vectors_of(rnd, 60, 0, 400), vectors_of(rnd, 80, 0, 400), 0.6
    weights, bias = T.fit(toxic, free, prior, steps=400)
    used = np.flatnonzero(weights).astype(np.int32)
    _, clean, *_ = T.risk(T.Rows(toxic, used), T.Rows(free, used), prior, np.append(weights[used], bias))
    assert np.isfinite(weights).all() and len(used) > 50 and clean > -0.1


def test_scores_dont_depend_on_batches():
    rnd = np.random.default_rng(1)
    w = rnd.normal(size=1 << T.BITS)
    texts = ["", None, "One two three", "é " * 50, "word " * 300_000, "One two three"]
    together = T.logits(pa.array(texts), w, 0.3)
    alone = [T.logits(pa.array([t], pa.string()), w, 0.3)[0] for t in texts]
    assert np.allclose(together, alone)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "text", 1), (2, "", 1), (3, "word", 1), (3, "word", 1)], "doc_id long, text string, __toxicity int")
    for labels in ([], [(3, 0)], [(None, 1), (3, None)], [(77, 1)], [(1, 1)]):
        df = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert T.toxic_ids(docs, df).count() == 0
        assert T.without_toxic(docs, df).count() == 5
    some = spark.createDataFrame([(3, 1), (3, 0), (2, 0)], "doc_id long, toxic int")
    assert T.scored(docs, some).count() == 5 and T.scored(docs.where("false"), some).count() == 0
