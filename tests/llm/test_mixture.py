"""Mixture-controlled packing against a round-robin that grants one token at a time, and exact tiling of every document."""

import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import mixture as M
from ferrule.llm import token_counts as C


def tokens(text):
    with open(C.VOCABULARY, "rb") as f:
        return len(C.encoding(f.read()).encode_ordinary(text))


class Queue:
    """A node of the round-robin, token by token: each of its halves carries its deficit, what it is owed beyond what it got."""

    def __init__(self, totals, weights):
        self.left = sum(totals)
        if len(totals) == 1:
            self.halves, self.leaves = None, [[totals[0], Fraction(totals[0]), weights[0]]]
        else:
            mid = len(totals) // 2
            self.halves = [Queue(totals[:mid], weights[:mid]), Queue(totals[mid:], weights[mid:])]
            self.deficit = Fraction(0)  # of the first half
            self.leaves = [[t, Fraction(t), w] for t, w in zip(totals, weights)]  # tokens, what of them isn't owed yet, weight

    def grant(self, out, lo=0):
        self.left -= 1
        if self.halves is None:
            out[lo] += 1
            return
        owed, mid = Fraction(1), len(self.leaves) // 2
        while owed:  # by weight among those of which something isn't owed yet
            live = [x for x in self.leaves if x[1]]
            step = min([owed / sum(x[2] for x in live), *(x[1] / x[2] for x in live)])
            for i, x in enumerate(self.leaves):
                if x in live:
                    x[1] -= step * x[2]
                    self.deficit += step * x[2] * (i < mid)
            owed -= step * sum(x[2] for x in live)
        first = self.deficit >= 1
        self.deficit -= first
        self.halves[not first].grant(out, lo + (0 if first else mid))


queues = st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0.0, 0.1, 1.0, 3.0, 20.0])), min_size=1, max_size=6)


@settings(max_examples=40, deadline=None)
@given(queues)
def test_plan_is_the_round_robin(queues):
    totals, shares = [t for t, _ in queues], [w for _, w in queues]
    plan = M.Plan(totals, shares)
    units = M._units(shares) if sum(shares) else [0] * len(shares)
    sent, want = np.zeros(len(totals), int), [[0] * len(totals)]
    for use, these in ((units, [s for s, t in enumerate(totals) if t and units[s]]), (M._units(totals) if sum(totals) else [], [s for s, t in enumerate(totals) if t and not units[s]])):
        if these:
            root = Queue([totals[s] for s in these], [use[s] for s in these])
            while root.left:
                out = [0] * len(these)
                root.grant(out)
                sent[these] += out
                want.append(sent.tolist())
    n = np.arange(sum(totals) + 1)
    got = np.array([plan.sent(s, n) for s in range(len(totals))])
    assert got.T.tolist() == want
    assert (plan.all_sent(n, np.arange(len(totals))) == got).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.sampled_from([0.0, 0.1, 1.0, 3.0, 20.0])), min_size=1, max_size=9), st.integers(1, 300))
def test_plan_shares(queues, tokens):
    totals, shares = [t for t, _ in queues], [w for _, w in queues]
    plan = M.Plan(totals, shares)
    n = np.arange(sum(totals) + 1)
    sent = np.array([plan.sent(s, n) for s in range(len(totals))])
    assert (sent.sum(0) == n).all() and (np.diff(sent, axis=1) >= 0).all()
    assert sent[:, -1].tolist() == totals
    # while all with a share have tokens left, each has its share up to the carried deficit
    units = np.array(M._units(shares) if sum(shares) else [0] * len(shares))
    used = (units > 0) & (np.array(totals) > 0)
    if used.any() and used.sum() == (units > 0).sum():
        end = int(np.argmax((sent[used] >= np.array(totals)[used, None]).any(0)))
        fair = n[:end] * (units / units.sum())[:, None]
        assert (np.abs(sent[:, :end] - fair) <= 1 + np.log2(len(totals)) + 1).all()
    for s, t in enumerate(totals):
        group = plan.group(s, np.arange(t), tokens)
        assert all(plan.sent(s, np.array([g * tokens]))[0] <= i < plan.sent(s, np.minimum(np.array([(g + 1) * tokens]), plan.total))[0] for i, g in enumerate(group))


def test_plan_of_many_sources_and_many_tokens():
    rnd = np.random.default_rng(0)
    totals = rnd.integers(1, 10**10, 10_000).tolist()
    began = time.monotonic()
    plan = M.Plan(totals, [t**M.TEMPER for t in totals])
    n = np.linspace(0, plan.total, 50).astype(np.int64)
    assert (plan.all_sent(n, np.arange(10_000)).sum(0) == n).all()
    assert time.monotonic() - began < 5
    huge = M.Plan([3 * 10**17, 10**17, 5], [3.0, 1.0, 0.0])
    n = np.array([0, 4, 4 * 10**16, 4 * 10**17, 4 * 10**17 + 5])
    assert huge.all_sent(n, np.arange(3)).T.tolist() == [[0, 0, 0], [3, 1, 0], [3 * 10**16, 10**16, 0], [3 * 10**17, 10**17, 0], [3 * 10**17, 10**17, 5]]


def corpus(seed, n=300):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "über", "x", "tion", "hello"])
    size = {"hot": 60, "mid": 30, "small": 10, None: 20}
    return [(i, " ".join(word() for _ in range(rnd.randint(0, 2 * size[s]))), s) for i in range(n) for s in [rnd.choice(["hot"] * 6 + ["mid", "small", None])]]


def check(rows, docs, window):
    """All windows full, each document tiled without gap or overlap; tokens of each window by source."""
    rows = sorted(rows, key=lambda r: r["window"])
    assert [r["window"] for r in rows] == list(range(len(rows)))
    assert all(r["tokens"] == window for r in rows[:-1])
    pieces, mix = defaultdict(list), []
    for r in rows:
        assert sum(r["lengths"]) == r["tokens"] and len(r["sources"]) == len(r["doc_ids"]) == len(r["doc_starts"]) == len(r["lengths"])
        c = Counter()
        for s, d, a, n in zip(r["sources"], r["doc_ids"], r["doc_starts"], r["lengths"]):
            pieces[d].append((a, a + n))
            c[s] += n
            assert docs[d][1] == s
        mix.append(c)
    for d, (text, _) in docs.items():
        n, at = tokens(text), 0
        for a, z in sorted(pieces.pop(d, [])):
            assert a == at
            at = z
        assert at == n
    assert not pieces
    return mix


def test_windows(spark, monkeypatch):
    docs = corpus(1)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, sid int").repartition(3)
    by_id = {i: (t, s) for i, t, s in docs}
    size = Counter()
    for t, s in by_id.values():
        size[s] += tokens(t)
    want = {s: n**M.TEMPER for s, n in size.items()}
    first = check(M.pack_mixture(df, window=64, group_windows=4).collect(), by_id, 64)
    monkeypatch.setattr(M, "BUCKET", 7)
    again = check(M.pack_mixture(df, window=64, group_windows=1000).collect(), by_id, 64)
    for mix in (first, again):
        got = Counter()
        for k, c in enumerate(mix[: len(mix) // 3], 1):  # no source is dry yet
            got += c
            for s in want:
                assert abs(got[s] - k * 64 * want[s] / sum(want.values())) < 6 + k * 64 * 1e-4
    assert sum(first, Counter()) == sum(again, Counter()) == size
    # how windows are grouped changes no row
    a, b = ({r["window"]: tuple(r) for r in M.pack_mixture(df, window=64, group_windows=g).collect()} for g in (3, 100))
    assert a == b
    order = sorted(size, key=lambda s: (s is None, s or ""))
    plan = M.Plan([size[s] for s in order], [size[s] ** M.TEMPER for s in order])
    taken = np.diff(plan.all_sent(np.minimum(np.arange(len(again) + 1) * 64, plan.total), np.arange(len(order))), axis=1).T
    assert [[c[s] for s in order] for c in again] == taken.tolist()


def test_targets(spark):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    by_id = {i: (t, s) for i, t, s in docs}
    mix = check(M.pack_mixture(df, {"small": 0.5, "hot": 0.25, "mid": 0.25}, window=32, group_windows=5).collect(), by_id, 32)
    assert 15 <= mix[0]["small"] <= 17 and mix[0][None] == 0
    seen = [k for k, c in enumerate(mix) if c[None]]
    assert min(seen) >= max(k for k, c in enumerate(mix) if c["hot"] or c["mid"] or c["small"]) - 1  # the one left out comes last


def test_edges(spark):
    schema = "doc_id long, text string, source string, window int"
    rows = [(1, None, "a", 0), (None, "some text", None, 0), (2, "", "a", 0), (3, "same", "b", 0), (3, "same", "b", 0), (4, "word " * 40000, "a", 0)]
    df = spark.createDataFrame(rows, schema)
    out = M.pack_mixture(df, window=128, group_windows=3).collect()
    n = Counter()
    for r in out:
        for d, k in zip(r["doc_ids"], r["lengths"]):
            n[d] += k
    assert n == {None: tokens("some text"), 3: 2 * tokens("same"), 4: tokens("word " * 40000)}
    assert M.pack_mixture(df.where("false")).count() == 0 and M.pack_mixture(df.where("doc_id < 3")).count() == 0
